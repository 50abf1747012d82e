r"""Chat formatting of reply trees (native).

Iterative self-joins double, for every node, how far up an ancestor is known, and with it the part of each leaf's path that
is listed, so a tree of depth d takes log2(d) rounds and its paths are as many rows as they have nodes.  Branches (leaves)
are ranked by score and each chosen root-to-leaf path becomes one conversation; texts join the chosen paths only.

Template, per turn: `<|im_start|>`, role, newline, text, `<|im_end|>`, newline.  In roles and texts a backslash is doubled
and a backslash is put behind the first character of every control string, so none survives inside a text; dropping one
backslash of each pair gives the text back.  Newlines in roles are escaped too.  Text of assistant turns is under the loss
mask, given as code-point spans of the formatted string.
"""

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that must not survive inside a text (fixed values).
CONTROL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"


def escape(text, role: bool = False) -> F.Column:
    """text with its control strings broken up, reversibly; a null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    text = F.regexp_replace(text, rf"(?=(?:{CONTROL}))(.)", r"$1\\")
    return F.regexp_replace(text, "\n", "\\\\\n") if role else text


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, up): every node on the way from each leaf to its root, `up` steps above the leaf.

    nodes: conv, node, parent (null, or not there: a root).  Round k joins a table of ancestors 2^k steps up with the nodes
    listed so far, which are those less than 2^k steps up, and with itself; rounds stop when no leaf has an ancestor so far
    up.  Leaves below a cycle of parents reach no root and are left out, as are the nodes of the cycle.
    """
    here = nodes.select("conv", "node")
    jump = cut(nodes.select("conv", "node", F.col("parent").alias("to")).join(here.withColumnRenamed("node", "to"), ["conv", "to"], "left_semi").select("conv", "node", "to"), "chat-up")
    leaves = here.join(jump.select("conv", F.col("to").alias("node")), ["conv", "node"], "left_anti")
    listed = cut(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-0")
    most = here.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for k in count():
        step = cut(listed.join(jump, ["conv", "node"]).select("conv", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up")), f"chat-{k + 1}")
        if step.isEmpty():
            return listed
        if 1 << k > most:
            # No path is longer than its tree has nodes: what still goes up goes round.
            return listed.join(step.select("conv", "leaf").distinct(), ["conv", "leaf"], "left_anti")
        listed = listed.unionByName(step)
        jump = cut(jump.join(jump.select("conv", F.col("node").alias("to"), F.col("to").alias("next")), ["conv", "to"]).select("conv", "node", F.col("next").alias("to")), "chat-up")


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, score, n_turns, formatted, loss_spans) for each chosen branch.

    nodes: conv, node (unique in conv), parent, role, text, score.  A branch scores the mean of its nodes' scores (null: 0);
    ties go to the smaller leaf.  branches: how many of a tree to keep, None for all.  Null roles and texts are empty; a null
    conv is a conversation of its own; a very long text or path makes one long row, as the format asks; rows that share
    conv and node follow each other as turns, by role and text, below the least of their parents; extra columns are ignored; no nodes, no rows.
    """
    nodes = nodes.select(F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv").cast("string"))).alias("conv"), F.col("conv").alias("_conv"), "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    narrow = cut(nodes.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.avg("score").alias("score")), "chat-nodes")
    listed = paths(narrow.drop("score"))
    ranked = listed.join(narrow.drop("parent"), ["conv", "node"]).groupBy("conv", "leaf").agg(F.avg("score").alias("branch_score"), F.max("up").alias("top"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    written = nodes.select("conv", "_conv", "node", escape(F.col("role"), True).alias("role"), escape(F.col("text")).alias("text"))
    turns = listed.join(cut(ranked, "chat-ranked"), ["conv", "leaf"]).withColumn("pos", F.col("top") - F.col("up")).join(written, ["conv", "node"])
    # A turn starts behind those before it: sums along the path, so spans cost no more than their number.
    before = Window.partitionBy("conv", "leaf").orderBy("pos", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), "role", F.lit("\n"))
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("role") + F.length("text") + len(START) + len(END) + 2).over(before), F.lit(0)) + F.length(head))
    turn = F.struct("pos", F.concat(head, "text", F.lit(END + "\n")).alias("written"), (F.col("role") == "assistant").alias("loss"), F.col("at").cast("int").alias("start"), (F.col("at") + F.length("text")).cast("int").alias("end"))
    whole = turns.groupBy("conv", "leaf").agg(F.first("_conv").alias("_conv"), F.first("rank").alias("rank"), F.first("branch_score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    return whole.select(F.col("_conv").alias("conv"), "leaf", "rank", "score", F.size("turns").alias("n_turns"), F.array_join(F.col("turns.written"), "").alias("formatted"), spans.alias("loss_spans"))


def cut_spans(text, spans, page: int = 4096) -> F.Column:
    """The pieces of text in spans (structs start, end in code points).  Text is cut into pages first: to find a place,
    a long text is not read from its start again for each span."""
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{page}}}"), F.lit(0))
    some = lambda held, s: F.array_join(F.slice(held, F.floor(s.start / page).cast("int") + 1, F.floor(s.end / page).cast("int") - F.floor(s.start / page).cast("int") + 1), "")
    # The pages are an element of an array, so that they are made once and not for every span.
    return F.flatten(F.transform(F.array(pages), lambda held: F.transform(spans, lambda s: F.substring(some(held, s), s.start % page + 1, s.end - s.start))))


def read_back(formatted) -> F.Column:
    """array<struct<role,text>> of a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    head = r"(?s)^((?:\\.|[^\\\n])*+)\n(.*)<\|im_end\|>\n$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))

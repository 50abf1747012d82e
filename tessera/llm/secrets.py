r"""Secret scans over a trigram inverted index (native).

Each rule's regular expression gives a Boolean query of trigrams that every match must contain.  The index lists, for
each trigram that some query asks for, the documents that hold it; a rule's candidates are the documents on all postings
of one of its conjunctions.  Only candidates are searched with the expression.  Rules without mandatory trigrams are
searched everywhere.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost non-overlapping matches; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_WORDS = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
#: The base kinds in their order.  Runs of 24 or more hexadecimal digits, and of 16 or more behind AKIA, are those runs
#: of the shorter patterns that are long enough.
BASE = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, in public formats (fixed values).
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


class _Other(Exception):
    """The pattern holds more than literals, classes, groups, alternatives and repeats."""


def _parse(p: str) -> list[list[tuple]]:
    """The alternatives of a pattern, each a list of (what, least, most): what is a set of characters, None where that is
    of no use to an index, or a list of alternatives.  Means the same in Java's grammar and in RE2's."""
    at = 0

    def one() -> str:
        nonlocal at
        if p[at] != "\\":
            at += 1
            return p[at - 1]
        if p[at + 1 : at + 2] == "x":
            at += 4
            return chr(int(p[at - 2 : at], 16))
        at += 2
        if at > len(p) or p[at - 1].isalnum():
            raise _Other
        return p[at - 1]

    def members() -> set | None:
        nonlocal at
        at += 1
        if p[at] in "^[" or "&&" in p[at:]:
            raise _Other
        found = set()
        while p[at] != "]":
            if p[at] == "[":
                raise _Other
            first = last = one()
            if p[at] == "-" and p[at + 1] != "]":
                at += 1
                last = one()
            found |= {chr(c) for c in range(ord(first), ord(last) + 1)}
        at += 1
        return found

    def repeat() -> tuple[int, float]:
        nonlocal at
        least, most = 1, 1
        if at < len(p) and p[at] in "?*+":
            least, most = {"?": (0, 1), "*": (0, float("inf")), "+": (1, float("inf"))}[p[at]]
            at += 1
        elif at < len(p) and p[at] == "{":
            end = p.index("}", at)
            lo, comma, hi = p[at + 1 : end].partition(",")
            least, most, at = int(lo), float(hi or "inf") if comma else int(lo), end + 1
        else:
            return 1, 1
        if at < len(p) and p[at] in "?+*":
            raise _Other
        return least, most

    def alternatives() -> list[list[tuple]]:
        nonlocal at
        found = [[]]
        while at < len(p) and p[at] != ")":
            if p[at] == "|":
                at += 1
                found.append([])
                continue
            if p[at] == "(":
                if p[at + 1] == "?":
                    raise _Other
                at += 1
                what = alternatives()
                at += 1
            elif p[at] in "^$":
                raise _Other
            elif p[at] == ".":
                at, what = at + 1, None
            else:
                what = members() if p[at] == "[" else {one()}
            found[-1].append((what, *repeat()))
        return found

    return alternatives()


def _runs(items: list[tuple]) -> list[set[str]]:
    """Consecutive sets of lower-case strings that a match must contain; a run ends where what follows is not contiguous."""
    done, now = [], {""}
    for what, least, most in items:
        if isinstance(what, list):
            inner = [_runs(x) for x in what] if least == most == 1 else [[], []]
            some = {y for r in inner for y in r[0]} if all(len(r) == 1 for r in inner) else None
        else:
            some = {c.lower() for c in what} if what else None
            some = some if some and len(some) <= 5 and (least == most == 1 or (len(some) == 1 and (least, most) == (0, 1))) else None
        if some is None:
            done.append(now)
            now = {""}
        else:
            now = {x + y for x in now for y in some} | (now if least == 0 else set())
    return [*done, now]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of trigrams, one of which every match holds; empty if there are no mandatory trigrams."""
    try:
        found = _parse(pattern)
    except (_Other, IndexError, ValueError):
        return []
    whole = [frozenset()]
    for run in _runs([(found, 1, 1)] if len(found) > 1 else found[0]):
        if all(len(x) >= 3 for x in run):
            whole = [a | {x[i : i + 3] for i in range(len(x) - 2)} for a in whole for x in run]
    whole = list(dict.fromkeys(whole))
    return [] if any(not c for c in whole) else whole


def _found(text, rule: Rule) -> F.Column:
    """array<struct<start,end>> of a rule's matches in text, in code points."""
    gaps, got, kept = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
    lengths = F.zip_with(F.transform(gaps, F.length), F.zip_with(F.transform(got, F.length), F.transform(kept, F.length), lambda m, k: F.struct(m.alias("m"), k.alias("k"))), lambda g, x: F.struct(g.alias("g"), x.alias("x")))
    span = lambda acc, x: F.struct((acc.at + x.g).alias("start"), (acc.at + x.g + x.x.m).alias("end"))
    return F.aggregate(
        F.filter(lengths, lambda x: x.x.isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, x: F.struct((acc.at + x.g + x.x.m).alias("at"), F.when(x.x.k >= rule.least, F.concat(acc.spans, F.array(span(acc, x)))).otherwise(acc.spans).alias("spans")),
        lambda acc: acc.spans,
    )


def _named(rank: int, kind: str):
    return lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind"))


def candidates(docs: DataFrame, rules, text_col: str) -> DataFrame:
    """(__key, __rules): for every document on the postings of a conjunction, the kinds to verify.  docs has __key."""
    asked = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for g in sorted(c)]
    grams = sorted({g for _, _, g, _ in asked})
    low = docs.select("__key", F.lower(text_col).alias("_t"))
    postings = low.select("__key", F.explode(F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    # One row for each trigram of a rule's query: the size is that of the rules, not of the data.
    query = F.broadcast(docs.sparkSession.createDataFrame(asked, "kind string, conj int, gram string, need int"))
    met = postings.join(query, "gram").groupBy("__key", "kind", "conj", "need").agg(F.count("*").alias("n")).filter("n >= need")
    return met.groupBy("__key").agg(F.collect_set("kind").alias("__rules"))


def scan(docs: DataFrame, rules=BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start,end,rank,kind>> (code points, end exclusive) by start, then order of rules.

    Null and empty texts hold none.  Rows are matched to the index by a hash of id and text, so repeated rows, repeated
    and null ids are each scanned.  A column named secrets is replaced.
    """
    keyed = docs.drop("secrets").withColumn("__key", F.xxhash64(id_col, text_col))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    found = cut(candidates(keyed, indexed, text_col), "secret-candidates")
    joined = keyed.join(found, "__key", "left").withColumn("__rules", F.coalesce("__rules", F.array().cast("array<string>")))
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.expr("cast(array() as array<struct<start:int,end:int>>)")
    each = []
    for rank, r in enumerate(rules):
        here = F.array_contains("__rules", r.kind) if r in indexed else text.rlike(r.pattern)
        spans = F.when(here, _found(text, r)).otherwise(none)
        each.append(F.transform(spans, _named(rank, r.kind)))
    return joined.withColumn("secrets", F.array_sort(reduce(F.concat, each) if len(each) > 1 else each[0])).drop("__key", "__rules")

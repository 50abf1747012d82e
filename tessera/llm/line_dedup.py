"""Line dedup by an exact set-similarity join (native).

A line is its set of words.  Equal sets are one, at their earliest line.  Each set's words are ordered by rarity, and two
sets of Jaccard similarity of 80 % or more share one of their first n - ceil(0.8 n) + 1 words (prefix filter), are of near
sizes (length filter) and can still meet their overlap from that word on (positional filter).

A line goes if an earlier line has the same set or a similar one, so one earlier match is enough.  The first round
compares each set with the earliest set, and with the BEFORE sets just before it, on each of the MIDDLE words in the middle
of its prefix; the second joins those that are left with all
earlier sets.  A crowd of near copies thus costs about its size in pairs, and no match is lost.  A 64-bit map of word
parities, and a second one by other bits (of long sets: by quarters of the words), keep out most pairs that share a word
by chance: they differ in no more bits than the sets differ in words.

Rarity is looked up in a fixed number of counts by hash of the word (BUCKETS), over all words; words that share a count
are ordered by hash, so the order is total and the same everywhere, and only a bounded table leaves the aggregation.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import constant_array, cut, passing, release

BUCKETS, MIDDLE, BEFORE, LONG, PARTS = 1 << 16, 4, 8, 96, 3
#: White space besides the space and the line feed.
OTHER = "\t\x0b\x0c\r"
LOW = (1 << 54) - 1
MAPS = ("bm", "q1", "q2", "q3")
#: Hashes hardly repeat: a dictionary of them costs time and gives no room.
PLAIN = {"parquet.enable.dictionary": "false"}


def _spaced(text) -> F.Column:
    """text with a space for OTHER; most texts have none and are only searched."""
    some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in OTHER])
    return F.when(some, F.translate(text, OTHER, " " * len(OTHER))).otherwise(text)


def rarity(docs: DataFrame) -> F.Column:
    """The array of codes, by bucket, that order words from rare to common."""
    # Empty pieces are counted as a word, too: any counts give a total order.
    counts = docs.select(F.explode(F.split(F.replace(_spaced(F.col("_text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg((F.log2(F.count("*") + 1) * 8).cast("int").alias("code"))
    found = {r.b: r.code for r in counts.collect()}  # BUCKETS rows at most
    return constant_array([found.get(b, 0) << 54 for b in range(BUCKETS)])


def _ids(line, codes) -> F.Column:
    """The sorted distinct words of a line as longs: 9 bits of rarity code, then 54 of hash."""
    # Spark sorts and compares longs as such only where no null can be among them, and only outside of transforms: there,
    # every step of a word is an object, so what can be done to whole arrays is.
    code = lambda h: F.coalesce(F.get(codes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))
    ranked = lambda h: code(h).bitwiseOR(h.bitwiseAND(F.lit(LOW)))
    pieces = F.array_distinct(F.transform(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), ranked))
    return F.sort_array(F.array_remove(pieces, ranked(F.xxhash64(F.lit("")))))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("_id", F.xxhash64("_text").alias("th"), F.posexplode(F.split(_spaced(F.col("_text")), "\n", -1)).alias("no", "line"))


def _identified(lines: DataFrame, codes) -> DataFrame:
    """lines with ids, n, and the set's name: a hash s1 and the parities bm."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda ids, skip=0: F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(F.shiftright(x, skip) if skip else x)))
    part = lambda w: parity(F.filter("ids", lambda x: x.bitwiseAND(F.lit(192)) == 64 * w))
    marked = lines.withColumn("ids", _ids(F.col("line"), codes)).drop("line")
    marked = marked.withColumn("n", F.size("ids")).withColumn("s1", F.xxhash64("ids")).withColumn("bm", parity("ids"))
    # A long set has many words for 64 parities: it has them by quarters of the words, too.  A short one has them by other bits.
    for w in (1, 2, 3):
        marked = marked.withColumn(f"q{w}", F.when(F.col("n") >= LONG, part(w)).otherwise(parity("ids", 8) if w == 1 else F.lit(0).cast("long")))
    return marked


def _need(n) -> F.Column:
    """ceil(0.8 n)."""
    return F.floor((4 * n + 4) / 5).cast("int")


def _may_match(x, y) -> F.Column:
    """Length, positional and parity filters; x and y give the columns n, i (place of the common word), bm, q1, q2, q3.

    In whole numbers: an overlap of ceil(4 (n + m) / 9) fits behind the places if 9 times the shorter rest is 4 (n + m) or
    more, which implies the length filter; as parities differ in n + m bits less an even number, it leaves room for them if
    9 times their difference is n + m or less.
    """
    n, m = x("n"), y("n")
    apart = [F.bit_count(x(c).bitwiseXOR(y(c))) for c in ("bm", "q1", "q2", "q3")]
    rest = lambda z: z("bm").bitwiseXOR(z("q1")).bitwiseXOR(z("q2")).bitwiseXOR(z("q3"))
    quarters = apart[1] + apart[2] + apart[3] + F.bit_count(rest(x).bitwiseXOR(rest(y)))
    second = F.when((n < LONG) & (m < LONG), apart[1]).when((n >= LONG) & (m >= LONG), quarters).otherwise(0)
    near = (9 * apart[0] <= n + m) & (9 * second <= n + m)
    return (9 * F.least(n - x("i"), m - y("i")) >= 4 * (n + m)) & near


def _marked(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """sets with g: whether they are in gone (s1, bm).  What the bit map does not pass needs no join."""
    may = passing(gone.withColumn("k", F.col("s1")), "k")
    keyed = sets.withColumn("k", F.col("s1"))
    some = keyed.filter(may).join(gone.withColumn("g", F.lit(True)), ["s1", "bm"], "left").withColumn("g", F.coalesce("g", F.lit(False)))
    return some.drop("k").unionByName(keyed.filter(~may).withColumn("g", F.lit(False)).drop("k"))


def _postings(firsts: DataFrame, name: str, most: int) -> DataFrame:
    """(tok, <name>): one row for each of the `most` middle prefix words of a set, with a struct (_id, no, n, i, bm).

    A changed word is often new and so the rarest; the middle of the prefix is what near copies keep.
    """
    size = F.size("prefix")
    words = F.slice("prefix", F.floor((size - F.least(F.lit(most), size)) / 2).cast("int") + 1, most)
    rows = firsts.select("_id", "no", "n", *MAPS, F.posexplode(words).alias("k", "tok"), F.floor((size - F.least(F.lit(most), size)) / 2).cast("int").alias("off"))
    return rows.select("tok", F.struct("_id", "no", "n", (F.col("k") + F.col("off")).alias("i"), *MAPS).alias(name))


def _met(marked: DataFrame, part: int) -> DataFrame:
    """Pairs (a, b) of sets that share a prefix word of one part of the words and pass the filters; b must still be there."""
    words = marked.select("_id", "no", "n", *MAPS, "g", F.posexplode("prefix").alias("i", "tok")).filter(F.pmod("tok", F.lit(PARTS)) == part)
    # The positional filter holds the smaller set to its first n / 9 + 1 words.
    met = words.alias("y").hint("merge").join(words.filter("9 * i <= n").alias("x"), "tok")
    x, y = F.struct("x._id", "x.no"), F.struct("y._id", "y.no")
    # Of equal sizes the earlier set is x; the later set must still be there.
    live = F.when(x < y, ~F.col("y.g")).otherwise((y < x) & (F.col("x.n") < F.col("y.n")) & ~F.col("x.g"))
    met = met.filter((F.col("x.n") <= F.col("y.n")) & _may_match(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & live)
    return met.select(F.when(x < y, x).otherwise(y).alias("a"), F.when(x < y, y).otherwise(x).alias("b")).distinct()


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.struct("a._id", "a.no").alias("a"), F.struct("b._id", "b.no").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, codes) -> DataFrame:
    """(s1, bm): the sets at places b of pairs (a, b: structs _id, no) that have a Jaccard similarity of 0.8 or more with an
    earlier set at a."""
    names = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    wanted = cut(names.select(F.xxhash64("a._id", "a.no").alias("k")).distinct(), "line-wanted")
    # A map of fixed size keeps out most other lines while the wanted are few, the join keeps out the rest at every size;
    # only then are words looked at.
    passed = _lines(docs).select("_id", "no", "line").withColumn("k", F.xxhash64("_id", "no")).filter(passing(wanted, "k")).join(wanted, "k", "left_semi")
    sets = cut(_identified(passed, codes).select(F.struct("_id", "no").alias("at"), "s1", "bm", "ids", "n"), "line-sets")
    side = lambda p: sets.select(F.col("at").alias(p), F.col("s1").alias(f"{p}s1"), F.col("bm").alias(f"{p}bm"), F.col("ids").alias(f"{p}ids"), F.col("n").alias(f"{p}n"), F.col("at").alias(f"{p}at"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    common = F.size(F.array_intersect("aids", "bids"))
    good = (F.col("aat") < F.col("bat")) & (100 * common >= 80 * (F.col("an") + F.col("bn") - common))
    return both.filter(good).select(F.col("bs1").alias("s1"), F.col("bbm").alias("bm")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""docs with n_lines, removed_lines (sorted numbers, from 0) and clean_text (the other lines, joined).

    Lines are what \n separates; earlier means a smaller (id, number), null ids first,
    so lines of one number in rows that share an id do not precede each other.  Lines without words stay.
    A null text has no lines and stays null; rows with equal id and text count as one document and lose the same lines;
    an empty table gives an empty result; columns of docs with the added names are replaced.
    """
    # The codes are a megabyte in the text of a plan, which the driver would keep for every query and every change of its plan.
    docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", 1 << 16)
    whole = docs.drop("n_lines", "removed_lines", "clean_text")
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    codes = rarity(plain)
    prefix = F.transform(F.slice("ids", 1, F.when(F.col("n") < 4, F.lit(0)).otherwise(F.col("n") - _need(F.col("n")) + 1)), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # Told by its text whether it has words: by its set, a line would be split and hashed twice.
    worded = _lines(plain).filter(F.trim("line") != "")
    # One shuffle brings the lines of each set together: the first row stands for the set, the places behind its place go.
    by = Window.partitionBy("s1", "bm").orderBy("_id", "no")
    lines = _identified(worded, codes).select("_id", "no", "th", "n", "s1", *MAPS, prefix.alias("prefix"))
    lines = lines.withColumn("row", F.row_number().over(by)).withColumn("place", F.dense_rank().over(by))
    lines = cut(lines.select("_id", "no", "th", "n", "s1", *MAPS, F.when(F.col("row") == 1, F.col("prefix")).alias("prefix"), (F.col("row") == 1).alias("top"), (F.col("place") > 1).alias("later")), "lines", **PLAIN)
    firsts = lines.filter("top").select("s1", "bm", "_id", "no", "n", "q1", "q2", "q3", "prefix")
    release(docs.sparkSession)
    crowd = firsts.filter("n >= 4")
    by = Window.partitionBy("tok").orderBy("b")
    # The earliest set is among the ones just before unless there are more of them.
    far = F.when(F.lag(F.lit(1), BEFORE + 1).over(by).isNotNull(), F.first("b").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    leaders = F.array(far, *[F.lag("b", k).over(by) for k in range(1, BEFORE + 1)])
    star = _postings(crowd, "b", MIDDLE).withColumn("a", leaders).select("b", F.explode("a").alias("a")).filter("a is not null")
    star = star.filter(_may_match(lambda c: F.col(f"b.{c}"), lambda c: F.col(f"a.{c}")) & (F.struct("a._id", "a.no") < F.struct("b._id", "b.no")))
    star = cut(_pairs(star), "line-star")
    gone = cut(_verified(star, plain, codes), "line-gone-1")
    release(docs.sparkSession)
    # Each part of the words is joined by itself: the shuffles of one part are gone before the next, so a part's size is all
    # the disk that postings take.  A pair that meets in several parts is one row of `rest`.
    marked, met = _marked(crowd, gone), []
    for part in range(PARTS):
        met.append(cut(_met(marked, part), "line-met"))
        release(docs.sparkSession)
    rest = cut(reduce(DataFrame.unionByName, met).distinct().join(star, ["a", "b"], "left_anti"), "line-rest")
    release(docs.sparkSession)
    gone = gone.unionByName(_verified(rest, plain, codes)).distinct()
    places = lines.select("_id", "no", "th", "s1", "bm", "later")
    removed = places.filter("later").unionByName(places.filter("not later").join(gone, ["s1", "bm"], "left_semi").select(places.columns))
    lost = removed.groupBy("_id", "th").agg(F.sort_array(F.collect_set("no")).alias("__lost")).withColumnsRenamed({"_id": "__lid", "th": "__lth"})
    keyed = whole.withColumn("__th", F.xxhash64(F.col(text_col).cast("string"))).withColumn("n_lines", F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n", -1)), F.lit(0)).cast("long"))
    out = keyed.join(lost, F.col(id_col).eqNullSafe(F.col("__lid")) & (F.col("__th") == F.col("__lth")), "left").withColumn("removed_lines", F.coalesce("__lost", F.array().cast("array<int>")))
    kept = F.filter(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x, k: ~F.array_contains("removed_lines", k))
    return out.withColumn("clean_text", F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))).drop("__th", "__lth", "__lid", "__lost")

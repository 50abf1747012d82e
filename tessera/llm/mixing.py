"""Mixing sources to target weights: fixed-length token blocks, dealt by index permutations."""

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, column_bytes, cut, hashed_words, hypergeometric, small_batches

BLOCK, SLOTS_A_SHARD, BUCKET_ROWS, LEAST_BLOCKS = 128, 65_536, 1 << 20, 64


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words wanted of each source: `share` of all by weight; what is above `most` times a source's size is shared anew."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in over or free:
            out[i] = float(most * sizes[i]) if i in over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index i of a pseudorandom permutation of 0..n-1 chosen by key: a four-round Feistel network, walked into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (right + k + np.uint64(r * 0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & m)
        x[todo] = (left << h) | right
        todo[todo.nonzero()[0]] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def block_words(size: int) -> int:
    """Words in a block of a source: BLOCK, fewer where that would leave it under LEAST_BLOCKS blocks."""
    return max(1, min(BLOCK, size // LEAST_BLOCKS))


def shard_counts(shard: int, shards: int, slots: int, totals: list[int], seed: int) -> tuple[list[int], list[int]]:
    """(before, own): how many slots of each source the shards before `shard`, and it itself, take.

    A multinomial draw per shard, given all totals: halves of the shards share the sources by exact hypergeometric draws,
    and so do their halves.  Each draw is seeded by its place, so any task finds any shard's counts without the others'.
    """
    lo, hi, before, own = 0, shards, [0] * len(totals), list(totals)
    room = lambda a, b: min(b * slots, sum(totals)) - min(a * slots, sum(totals))
    while hi - lo > 1:
        mid, rng = (lo + hi) // 2, random.Random(f"{seed} {lo} {hi}")
        want, left, total = room(lo, mid), [], sum(own)
        for c in own:
            got = hypergeometric(rng, c, total - c, want)
            left.append(got)
            total -= c
            want -= got
        if shard < mid:
            hi, own = mid, left
        else:
            lo, before, own = mid, [x + y for x, y in zip(before, left, strict=True)], [x - y for x, y in zip(own, left, strict=True)]
    return before, own


def deal(spark, totals: list[int], blocks: list[int], seed: int = 23, slots: int = SLOTS_A_SHARD) -> DataFrame:
    """(shard, slot, sid, block): the mixture itself, as the block of a source at every slot of every output shard.

    Shards have `slots` slots each, the last one what is left.  Slots of a shard are dealt to sources in random order; slot
    i of a source takes block permutation(i mod blocks).  Tasks get one number a source and draw what they need.
    """
    n = sum(totals)
    shards = -(-n // slots)

    def place(batches):
        import pyarrow as pa

        size = np.array(blocks, np.int64)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                before, own = (np.array(x, np.int64) for x in shard_counts(k, shards, slots, totals, seed))
                sid = np.repeat(np.arange(len(own)), own)
                i = np.arange(len(sid)) - np.repeat(np.cumsum(own) - own, own) + before[sid]
                at = np.random.default_rng([seed, k]).permutation(len(sid))
                block = permuted(i % size[sid], size[sid], (sid + 1) * 1_000_003 + seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), k)), pa.array(at.astype(np.int32)), pa.array(sid.astype(np.int32)), pa.array(block)], ["shard", "slot", "sid", "block"])

    return spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInArrow(place, "shard bigint, slot int, sid int, block bigint")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS_A_SHARD) -> DataFrame:
    """Per row of docs: id, text_hash, size (words), source_size, target (its source's), taken (words taken, repeats
    counted) and pieces: array of (first word, end word, shards), the runs of the row's words that lie in one block, each
    with the output shard of every time that the block is taken.

    Each source's rows, in a seeded order, form one token stream cut into blocks of BLOCK words (see block_words).  The
    number of blocks that each output shard takes of each source is a multinomial draw given its totals, so every source
    meets its target to within half a block; no block is taken more than `most` times.  Blocks of documents meet the
    slots that deal() gives in a join by index, and what is taken is counted there.

    Sources are ranked by code point, null last; weights repeat.  Null or empty texts have size 0 and nothing is taken;
    very long texts lie in many blocks; repeated rows are separate; an empty table gives an empty result; only the three
    named columns are read.  One row a source (a data set, not a document) reaches the driver and the tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.encode(text, "UTF-8"))).alias("h")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    total = [int(r.n) for r in found]
    want = targets(total, [weights[i % len(weights)] for i in range(len(total))], share, most)
    length = [block_words(t) for t in total]
    blocks = [-(-t // x) for t, x in zip(total, length, strict=True)]
    wanted = []
    for t, w, b, x in zip(total, want, blocks, length, strict=True):
        whole = int(w // t) if t else 0
        wanted.append(whole * b + min(b, round((w - whole * t) / x)))
    times = deal(spark, wanted, blocks, seed, slots).groupBy("sid", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))

    plan = spark.createDataFrame([(i, r.source, total[i], want[i], length[i], 1 + r.rows // BUCKET_ROWS) for i, r in enumerate(found)], "sid int, source string, source_size bigint, target double, words bigint, buckets bigint")
    rows = sized.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("k", F.pmod("h", "buckets"))
    # Word offsets in two levels: sums of buckets of about BUCKET_ROWS rows first, then a window in each, so no source is one task.
    buckets = rows.groupBy("sid", "k").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))).select("sid", "k", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "k").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).join(buckets, ["sid", "k"]).withColumn("start", F.col("before") + F.col("inside"))
    some, none = placed.filter("size > 0"), placed.filter("size = 0")
    keys = ["doc_id", "text_hash", "size", "source_size", "target"]
    parts = some.select("sid", "start", "words", *keys, F.explode(F.sequence(F.floor(F.col("start") / F.col("words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("words")))).alias("block"))
    first, end = F.greatest(F.lit(0).cast("long"), F.col("block") * F.col("words") - F.col("start")), F.least(F.col("size"), (F.col("block") + 1) * F.col("words") - F.col("start"))
    # The planner takes the few cells for the many slots they stand for and would broadcast them: merge instead.
    joined = parts.join(times.hint("merge"), ["sid", "block"], "left").withColumn("piece", F.struct(first.alias("first"), end.alias("end"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards")))
    done = joined.groupBy("sid", "start", *keys).agg(F.sum((F.col("piece.end") - F.col("piece.first")) * F.size("piece.shards")).alias("taken"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    empty = none.select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast(done.schema["pieces"].dataType).alias("pieces"))
    return done.select(*keys, "taken", "pieces").unionByName(empty)


def mixed_texts(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as the mixture takes them: each text becomes its taken pieces in order, each as often as it is taken; rows of
    which nothing is taken go.  Pieces are cut where words start, so a text taken once as a whole is unchanged.  Rows of
    equal id and text are numbered and each gets its own pieces; n_chars, where there is one, is counted anew; null and
    empty texts go, as does an empty table's nothing; other columns stay."""
    small_batches(docs.sparkSession)
    number = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    mine = mixture.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "taken", F.col("pieces").alias("__pieces")).withColumn("__n", number("__id", "__hash")).filter("taken > 0").drop("taken")
    keyed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("__k", number(id_col, "__h"))
    joined = keyed.join(mine, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")) & (F.col("__k") == F.col("__n"))).drop("__id", "__hash", "__n", "__h", "__k")
    out = docs.schema

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = column_bytes(text)
            new = []
            for k, ((_, starts, _e), pieces) in enumerate(zip(hashed_words(data, offsets), batch.column(batch.schema.get_field_index("__pieces")).to_pylist(), strict=True)):
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                cut_at = lambda w: lo if w == 0 else hi if w >= len(starts) else int(starts[w])  # noqa: E731, B023
                got = []
                for p in pieces:
                    piece = data[cut_at(p["first"]) : cut_at(p["end"])].tobytes()
                    if len(p["shards"]) > 1 and not piece[-1:].isspace():
                        piece += b"\n"
                    got.append(piece * len(p["shards"]))
                new.append(b"".join(got).decode())
            columns = []
            for f in out.fields:
                if f.name == text_col:
                    columns.append(pa.array(new, batch.schema.field(f.name).type))
                elif f.name == "n_chars":
                    columns.append(pa.array([len(x) for x in new]).cast(batch.schema.field(f.name).type))
                else:
                    columns.append(batch.column(batch.schema.get_field_index(f.name)))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return joined.mapInArrow(build, out)

"""Uniform shuffle into shards of exact sizes (native).

A hypergeometric communication matrix says how many rows of each block go to each shard.  Its margins are exact, so
shard sizes are, and given the matrix every block may permute and deal its rows alone; each shard then permutes what it
got.  All of that is done on names of rows (a hash of id and text, numbered among equal ones), a few bytes a row whatever
the texts' length; whole rows move once, to the place that their name was given.
"""

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, matrix_with_margins

#: Rows are counted by MOST_BLOCKS hashes; blocks and ranges of shards have about BLOCK_NAMES names of rows.
MOST_BLOCKS, BLOCK_NAMES = 8192, 1 << 20


def places(docs: DataFrame, shards: int, seed: int, id_col: str, text_col: str, most_names: int = BLOCK_NAMES) -> DataFrame:
    """(h, t, shard, slot): the place of row number t among the rows with hash h."""
    spark = docs.sparkSession
    names = cut(docs.select(_name(seed, id_col, text_col).alias("h")).groupBy("h").count(), "shard-names")
    counts = {r[0]: r[1] for r in names.groupBy(F.pmod("h", F.lit(MOST_BLOCKS)).alias("b")).agg(F.sum("count")).collect()}
    total = sum(counts.values())
    blocks = min(MOST_BLOCKS, max(64, 1 << (total // most_names).bit_length()))
    of_block = [sum(counts.get(b, 0) for b in range(k, MOST_BLOCKS, blocks)) for k in range(blocks)]
    rows = []
    for b, row in enumerate(matrix_with_margins(random.Random(seed), of_block, [total // shards + (s < total % shards) for s in range(shards)])):
        rows.append((b, [sum(row[: s + 1]) for s in range(shards)]))
    # At most MOST_BLOCKS rows of `shards` counts, whatever the input's size.
    matrix = F.broadcast(spark.createDataFrame(rows, "b int, ends array<bigint>"))
    order = lambda salt: [F.xxhash64(F.lit(seed + salt), "h", "t"), "h", "t"]
    numbered = names.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("t"))
    local = numbered.withColumn("b", F.pmod("h", F.lit(blocks)).cast("int")).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(*order(1))) - 1)
    dealt = local.join(matrix, "b").select("h", "t", F.size(F.filter("ends", lambda c: c <= F.col("r"))).alias("shard"))
    # A shard is permuted in ranges that each of its rows picks at random; where a range starts is known once all are counted.
    ranges = max(1, -(-total // shards // most_names))
    dealt = cut(dealt.withColumn("f", F.pmod(F.xxhash64(F.lit(seed + 2), "h", "t"), F.lit(ranges))), "shard-dealt")
    sizes = dealt.groupBy("shard", "f").count()
    before = Window.partitionBy("shard").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "f", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    again = dealt.withColumn("k", F.row_number().over(Window.partitionBy("shard", "f").orderBy(*order(3))) - 1)
    return again.join(starts, ["shard", "f"]).select("h", "t", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))


def _name(seed: int, id_col: str, text_col: str) -> F.Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.encode(text, "UTF-8")), F.octet_length(text))


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", most_names: int = BLOCK_NAMES) -> DataFrame:
    """Every row of docs with `shard` (0 to shards - 1) and `slot` (0, 1, ... in the shard).

    Law: rows - shard counts differ by one at most, so equal texts of different ids are not kept together.  A row's block
    is a hash of its id and text, so a retried task deals as before.  The driver sees only block counts (MOST_BLOCKS at
    most) and the matrix.

    Null ids and texts are values like any other; very long texts weigh no more than others, as they move once; repeated
    rows are placed one by one (equal rows may swap); an empty table gives an empty result; columns of docs named shard or
    slot are replaced.
    """
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    place = places(docs, shards, seed, id_col, text_col, most_names).select(F.col("h").alias("__shard_ph"), F.col("t").alias("__shard_pt"), "shard", "slot")
    keyed = docs.select(*rest, _name(seed, id_col, text_col).alias("__shard_h"))
    numbered = keyed.withColumn("__shard_t", F.row_number().over(Window.partitionBy("__shard_h").orderBy(F.lit(0))) - 1)
    # Rows are dealt by hash once: numbering and join share it, as the join need not be dealt by both of its keys.
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Places of all rows are many: merged, never broadcast.
    both = numbered.join(place.hint("merge"), (F.col("__shard_h") == F.col("__shard_ph")) & (F.col("__shard_t") == F.col("__shard_pt")))
    return both.select(*rest, "shard", "slot")

"""Line dedup by parts of the words: codes that sort as plain longs, postings of one part at a time."""

from pyspark.sql import functions as F

from tessera.llm import line_dedup


def test_ids_hold_no_nulls(spark):
    """Arrays that could hold nulls are sorted as objects."""
    docs = spark.createDataFrame([("b a b c",)], "line string")
    ids = docs.select(line_dedup._ids(F.col("line"), line_dedup.constant_array([0] * line_dedup.BUCKETS)).alias("ids"))
    assert not ids.schema["ids"].dataType.containsNull and len(ids.first().ids) == 3


def test_parts_make_up_all_pairs(spark):
    """Sets whose common prefix words lie in different parts: every part gives its own pairs, together all of them."""
    rows = [(1, 0, 20, [0, 4, 11, 20]), (2, 0, 20, [1, 4, 12, 21]), (3, 0, 20, [0, 5, 13, 22]), (4, 0, 20, [2, 5, 14, 23]), (5, 0, 20, [9, 1, 15, 24])]
    marked = spark.createDataFrame(rows, "_id long, no int, n int, prefix array<int>")
    marked = marked.select("*", *[F.lit(0).cast("long").alias(m) for m in line_dedup.MAPS], F.lit(False).alias("g"))
    parts = [{(r.a._id, r.b._id) for r in line_dedup._met(marked, k).collect()} for k in range(line_dedup.PARTS)]
    assert parts == [{(1, 3)}, {(1, 2), (2, 5)}, {(3, 4)}]

"""Dense indices of large and wide tables: every row once, in order, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered
from tessera.operators.vector import Vector


@pytest.mark.parametrize("parts", [4, 24])
def test_index_of_a_wide_table(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 1_500_000
        key = F.xxhash64("id")
        wide = spark.range(n).select(key.alias("k"), "id", *[F.sha2((F.col("id") + i).cast("string"), 256).alias(f"w{i}") for i in range(2)])
        got = ordered.with_index(wide, "k")
        one = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("id").alias("ids")).first()
        assert tuple(one) == (n, n, 0, n - 1, n)
        assert ordered.with_next(got.select("idx", "k"), ["k"]).filter("next_k < k").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reindex_of_a_filtered_vector(spark):
    v = Vector(spark.range(3_000_000).select(F.col("id").alias("idx"), (F.col("id") % 10).cast("double").alias("x")))
    kept = v.filter_gt(7)
    one = kept.df.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("hi"), F.sum(F.when(F.col("x") == 8 + F.col("idx") % 2, 1)).alias("right")).first()
    assert tuple(one) == (600_000, 600_000, 599_999, 600_000)
    assert ordered.reindex(v.df.filter("false"), "idx").isEmpty()

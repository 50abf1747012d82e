"""Line dedup: words of a line handled as whole arrays of longs, lines of one set brought together by one shuffle."""

from pyspark.sql import functions as F

from tessera.llm import line_dedup


def test_distinct_ids_outside_of_transforms(spark):
    """Within a transform every word is an object; empty pieces are no words."""
    docs = spark.createDataFrame([(" b a  b c ",), ("",)], "line string")
    ids = docs.select(line_dedup._ids(F.col("line"), line_dedup.constant_array([0] * line_dedup.BUCKETS)).alias("ids"))
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_distinct") < plan.index("transform(") and [len(r.ids) for r in ids.collect()] == [3, 0]


def test_lines_of_a_set_meet_once(spark, monkeypatch):
    """Later lines are known from the one shuffle by set; they need no table of first lines and no join with it."""
    tags, store = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, tag, **options: (tags.append(tag), store(df, tag, **options))[1])
    near = "a b c d e f g h i j"
    rows = [(1, f"{near}\nx\n \t\nx"), (1, f"{near}\nx\n \t\nx"), (1, "y\nx"), (2, f"{near} k\n{near} k"), (None, "x")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "line-firsts" not in tags and tags.count("lines") == 1
    assert sorted((r.doc_id or 0, r.n_lines, r.removed_lines) for r in got) == [(0, 1, []), (1, 2, [1]), (1, 4, [1, 3]), (1, 4, [1, 3]), (2, 2, [0, 1])]

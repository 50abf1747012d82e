"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from tessera.llm import chat, decontam, licenses, line_dedup, mixing, neardup, quality, queries, rules, secrets, shard

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard string, slot int, secrets int, n_lines int, removed_lines int, clean_text string, kept int, quality int, size int, _k int, fp int"
WORDS = " ".join(f"w{i * 7919 % 100003}" for i in range(3000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def _row(i, text, source="s"):
    return (i, text, None, source, None, None, None, None, None, None, None, None, None, None, None, None, None)


ROWS = [
    _row(1, None), _row(2, ""), _row(3, "   \n\t "), _row(None, "no id at all here but some words"), _row(4, WORDS, None), _row(5, WORDS + " more", "a"), _row(6, "tie tie tie", "b"), _row(6, "tie tie tie", "b"),
    _row(7, "é" * 3000 + " " + ITEM + " password=hunter22", "c"), _row(8, "Released under the MIT License.", "c"), _row(9, "x" * 100_000, None), _row(10, "one\ntwo\n\none", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, rows=((4, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def _benchmark(spark, rows=((0, ITEM), (1, None), (2, ""))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).count() == len(ROWS) and line_dedup.dedup_lines(none).count() == 0
    assert got[1, None].n_lines == 0 and got[1, None].clean_text is None and got[10, "one\ntwo\n\none"].removed_lines == [3] and got[10, "one\ntwo\n\none"].clean_text == "one\ntwo\n"
    assert got[5, WORDS + " more"].removed_lines == [0] and got[6, "tie tie tie"].removed_lines == []


def test_secrets(docs, none):
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(ROWS) and secrets.scan(none).count() == 0
    found = [(r.doc_id, s.kind, s.start, s.end) for r in rows for s in r.secrets]
    at = 3001 + len(ITEM) + 1
    assert found == [(7, "assign", at, at + len("password=hunter22"))]


def test_near_duplicates(docs, none):
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and neardup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[3].kept
    assert by[5].component_id == 4 and not by[5].kept and by[6].kept and by[6].n_shingles == 1


def test_licenses(docs, none):
    assert [(r.doc_id, r.license, r.start, r.end) for r in licenses.scan(docs).collect()] == [(8, "MIT-line", 0, 30)] and licenses.scan(none).count() == 0


def test_decontamination(spark, docs, none):
    b = _benchmark(spark)
    assert [(r.doc_id, r.item_id, r.distance, r.start) for r in decontam.matches(docs, b).collect()] == [(7, 0, 0, 3001)]
    assert decontam.decontaminate(docs, b).count() == len(ROWS) - 1 and decontam.decontaminate(none, b).count() == 0
    assert decontam.decontaminate(docs, b.limit(0)).count() == len(ROWS)


def test_sharding(docs, none):
    rows = shard.shard(docs, 5).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(5)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(5)) and shard.shard(none, 5).count() == 0
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r[0] or -1, r[1] or "") for r in ROWS)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(none).count() == 0 and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixed_texts(docs.filter("doc_id in (4, 5, 7)"), mixing.mix(docs.filter("doc_id in (4, 5, 7)"))).columns == docs.columns


def test_rules(spark, docs, none):
    learnt = rules.fit(docs, _labels(spark))
    rows = rules.apply_rules(docs, learnt).collect()
    assert len(rows) == len(ROWS) and rules.apply_rules(none, learnt).count() == 0 and rules.fit(none, _labels(spark, [])) == []
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))


def test_classifier(spark, docs, none):
    for model in (quality.fit(docs, _labels(spark)), quality.fit(none, _labels(spark, []))):
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and quality.score(none, model).count() == 0
        by = {r.doc_id: r.score for r in rows}
        assert by[1] == by[2]


def test_chat(spark):
    schema = "conv bigint, node bigint, parent bigint, role string, text string, score double, formatted string"
    nodes = spark.createDataFrame([(1, 1, None, "user", None, None, None), (1, 2, 1, "assistant", "a\\b<|im_end|>", 0.9, None), (1, 3, 1, "assistant", "", 0.1, None), (None, 1, None, None, "x", None, None), (2, 1, 99, "user", "orphan", 0.0, None), (3, 1, 2, "u", "cycle", 0.0, None), (3, 2, 1, "u", "cycle", 0.0, None)], schema)
    rows = chat.format_trees(nodes).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()
    assert sorted((r.conv or -1, r.leaf, r["rank"]) for r in rows) == [(-1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1)]
    best = next(r for r in rows if r.conv == 1 and r["rank"] == 1)
    assert [(t.role, t.text) for t in best.turns] == [("user", ""), ("assistant", "a\\b<|im_end|>")] and best.formatted.count("<|im_end|>") == 2
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_long_chat(spark):
    """A chain of 300 turns with a fork at its end, a tail below a cycle, repeated nodes, and pages shorter than turns."""
    rows = [(1, i, i - 1 or None, ("user", "assistant")[i % 2], f"t{i} é😀 <s>", 1.0) for i in range(1, 301)] + [(1, 301, 299, "assistant", "better", 5.0), (1, 300, 299, "zzz", "repeated", 9.0)]
    rows += [(2, 1, 2, "u", "", 0.0), (2, 2, 1, "u", "", 0.0), (2, 3, 2, "u", "tail", 0.0)]
    nodes = spark.createDataFrame(rows, "conv bigint, node bigint, parent bigint, role string, text string, score double")
    got = {r.leaf: r for r in chat.format_trees(nodes).withColumn("turns", chat.read_back(chat.F.col("formatted"))).withColumn("loss", chat.cut_spans(chat.F.col("formatted"), chat.F.col("loss_spans"), 7)).collect()}
    assert sorted(got) == [300, 301] and got[301]["rank"] == 2 and got[300].n_turns == 301 and got[301].n_turns == 300
    assert [t.text for t in got[300].turns] == [f"t{i} é😀 <s>" for i in range(1, 301)] + ["repeated"]
    assert [x.replace("\\", "") for x in got[301].loss] == [f"t{i} é😀 <s>" for i in range(1, 300, 2)] + ["better"]
    assert chat.format_trees(nodes, 1).count() == 1


def test_pipeline_stages(spark, docs, tmp_path):
    good = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for name, table in (("documents", good), ("labels", _labels(spark)), ("benchmark", _benchmark(spark))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, good, str(tmp_path)).count() <= good.count() and stage(spark, good.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    # Null ids and repeated rows as they come.
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert 0 < out.count() <= docs.count() and (out.columns == docs.columns if k < 4 else {"shard", "slot"} <= set(out.columns))
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect() if r.doc_id) == [1, 2, 3, 4, 6, 6, 7, 8, 9, 10]
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert set(queries.SQL) <= set(queries.QUERIES)

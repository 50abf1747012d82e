"""Whole-table queries: they read every row and every component of the smallest tables."""

import duckdb
import numpy as np

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def _column(table, what, order="1"):
    return [x[0] for x in duckdb.sql(f"select {what} from '{SF}/{table}.parquet' order by {order}").fetchall()]


def test_spectrum_of_the_whole_series(spark):
    want = np.fft.fft(np.array(_column("events", "value", "event_id"), float))
    got = catalogue.QUERIES["spectrum"](spark, SF).orderBy("k").collect()
    assert [r.k for r in got] == list(range(len(want)))
    assert np.allclose([complex(r.re, r.im) for r in got], want, atol=1e-3)


def test_transpose_whole(spark):
    rows = _column("embeddings", "embedding", "vec_id")
    got = {(r.i, r.j): r.x for r in catalogue.QUERIES["transpose"](spark, SF).collect()}
    assert len(got) == sum(map(len, rows)) and all(abs(got[i, j] - x) < 1e-6 for j, v in enumerate(rows) for i, x in enumerate(v))


def test_gram_of_whole_vectors(spark):
    v = np.array(_column("embeddings", "embedding", "vec_id"), float)
    got = catalogue.QUERIES["gram"](spark, SF).orderBy("i", "j").collect()
    assert np.allclose([r.x for r in got], (v.T @ v).ravel(), atol=1e-4)
    assert all(catalogue.QUERIES[n](spark, SF).count() == v.size for n in ("row_normalisations", "broadcast_add"))


def test_prod_of_all_rows(spark):
    want = np.prod(1 + np.array(_column("lineitem", "l_tax")) / 1e6)
    assert want > 1.0001 and abs(catalogue.QUERIES["norms_dot_prod"](spark, SF).first()["prod"] - want) < 1e-7


def test_queries_grow_with_the_table(spark):
    ids = _column("embeddings", "vec_id")
    asked = {i for i in ids if i % 50 == 0}
    assert catalogue.QUERIES["cdist"](spark, SF).count() == len(ids) * len(asked)
    assert {r.j for r in catalogue.QUERIES["nearest"](spark, SF).collect()} == asked

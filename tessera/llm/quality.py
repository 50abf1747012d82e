"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import column_bytes, held_out, hashed_words, mix64, small_batches
from tessera.llm.features import text_stats

MOST_ROWS, DIMENSIONS, RANK, SHARPNESS, FIT_BLOCK, NEIGHBOURS = 4_000, 4_096, 32, 24.0, 256, 200
_BUCKETS = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])


def term_counts(raw: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term indices, weights) of one text: hashed words, hashed first/last bytes of words, and binned text statistics."""
    stats = text_stats(raw, h, starts, ends)[5:]
    scaled = [stats[0] / 2, *stats[1:7], stats[7] / 15, stats[8], stats[9] / 60, stats[10]]
    binned = mix64(np.array([1 + i * 64 + np.searchsorted(_BUCKETS, v) for i, v in enumerate(scaled)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    extra = [binned]
    if len(h):
        edge = raw[starts].astype(np.uint64) | (raw[ends - 1].astype(np.uint64) << np.uint64(8)) | (np.minimum(ends - starts, 24).astype(np.uint64) << np.uint64(16))
        extra = [h, mix64(edge + np.uint64(1 << 40)), binned]
    terms, weights = [], []
    for k, part in enumerate(extra):
        u, c = np.unique(part % np.uint64(DIMENSIONS), return_counts=True)
        terms.append(u.astype(np.int64))
        # The statistics stand beside the words as one block of equal norm.
        weights.append((1 + np.log(c)) / np.sqrt(((1 + np.log(c)) ** 2).sum()) * (2.0 if k == len(extra) - 1 else 1.0))
    return np.concatenate(terms), np.concatenate(weights)


def _text_terms(column):
    data, offsets = column_bytes(column)
    for (h, s, e), a, b in zip(hashed_words(data, offsets), offsets[:-1], offsets[1:], strict=True):
        yield term_counts(data[a:b], h, s - a, e - a)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> dict:
    """Latent-semantic space and labelled vectors from at most `most_rows` labelled documents outside the held-out third
    (those first by a hash of their id).  The model is arrays of DIMENSIONS x RANK and most_rows x RANK floats, whatever
    the corpus: under 2 MB."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def terms(batches):
        import pyarrow as pa

        for batch in batches:
            got = list(_text_terms(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.astype(np.int16).tobytes() for t, _ in got], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in got], pa.binary())], ["doc_id", "quality", "t", "w"])

    # Rows that share an id are one (the least text by hash): at most most_rows rows reach the driver.
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(terms, "doc_id bigint, quality int, t binary, w binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    if not rows:
        return {"idf": np.ones(DIMENSIONS, np.float32), "axes": np.zeros((DIMENSIONS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "votes": np.zeros(0, np.float32), "prior": 0.5}
    terms_, weights = [np.frombuffer(r.t, np.int16) for r in rows], [np.frombuffer(r.w, np.float32) for r in rows]
    held = np.zeros(DIMENSIONS, np.int64)
    for t in terms_:
        held[np.unique(t)] += 1
    idf = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)

    def blocks():
        """The normalised rows as dense blocks; the whole matrix is never in memory."""
        for at in range(0, len(rows), FIT_BLOCK):
            x = np.zeros((min(FIT_BLOCK, len(rows) - at), DIMENSIONS), np.float32)
            for i in range(len(x)):
                np.add.at(x[i], terms_[at + i], weights[at + i])
            x *= idf
            yield x / np.linalg.norm(x, axis=1, keepdims=True)

    # Right singular vectors by subspace iteration with a fixed start.
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((DIMENSIONS, min(RANK + 8, len(rows)))))[0].astype(np.float32)
    for _ in range(8):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))[0]
    _, _, vt = np.linalg.svd(np.concatenate([x @ q for x in blocks()]), full_matrices=False)
    axes = (q @ vt.T[:, :RANK]).astype(np.float32)
    vectors = np.concatenate([x @ axes for x in blocks()])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    good = np.array([r.quality == 1 for r in rows], np.float32)
    return {"idf": idf, "axes": axes, "vectors": vectors.astype(np.float32), "votes": good, "prior": float(good.mean())}


def score_texts(terms: list, model: dict) -> np.ndarray:
    """Scores of texts: the share of good labels among the NEIGHBOURS labelled vectors nearest by cosine, each weighted by
    exp(SHARPNESS * cosine), classes balanced.  The products of a block of texts with all labelled vectors are exact; of
    vectors tied for the last place any may vote."""
    out = np.full(len(terms), model["prior"])
    if not len(model["vectors"]):
        return out
    rare = max(model["prior"], 1e-6), max(1 - model["prior"], 1e-6)
    weight = np.where(model["votes"] > 0, 1 / rare[0], 1 / rare[1])
    for at in range(0, len(terms), 256):
        block = terms[at : at + 256]
        v = np.stack([(w * model["idf"][t]) @ model["axes"][t] for t, w in block])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cosine, k = v @ model["vectors"].T, min(NEIGHBOURS, len(weight))
        who = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near = np.exp(SHARPNESS * (np.take_along_axis(cosine, who, 1) - 1)) * weight[who]
        out[at : at + 256] = (near * model["votes"][who]).sum(1) / np.maximum(near.sum(1), 1e-300)
    return np.clip(np.nan_to_num(out, nan=model["prior"]), 0, 1)


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out` (replaced if there), from 0 to 1: the higher, the likelier quality 1.  Whole texts are read;
    a null text scores as an empty one, without words but with statistics; a very long text is one vector like any other;
    repeated rows score alike; an empty table gives an empty result.  Only the text is used: no label, language, source or
    id."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = docs.drop(out)
    schema = StructType([*rest.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = score_texts(list(_text_terms(batch.column(batch.schema.get_field_index(text_col)))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, schema)

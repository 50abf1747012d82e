"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit distance.

All is on words.  The CGK random walk copies the word under a pointer at each step and moves the pointer on by a random
bit of (word, step); texts a few edits apart soon walk in step again, so edit distance becomes Hamming distance.  A hash
table keeps, for each of REPEATS independent walks, the words at SAMPLES sampled steps of every item.  A window of a
document that shares an entry is a candidate and its exact edit distance to the item decides.

Windows have the size of an item and stand where one can: with at most k edits, an item of n words keeps one of its
g-word runs whole if n - g + 1 > g k, so windows are placed by the runs that documents share with items.  This loses
no item; how many are lost by sampling is measured in the tests.

Items are broadcast in blocks of about BLOCK_CHARS characters, one block at a time: a larger benchmark takes several
passes over the documents, each written before the next block is made, so neither driver nor executors ever hold two.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_bytes, cut, hashed_words, mix64, small_batches

REPEATS, SAMPLES, BLOCK_CHARS, RATE = 48, 2, 4_000_000, 0.2
_END = np.uint64(0x9E3779B97F4A7C15)


def grams(h: np.ndarray, g: int) -> np.ndarray:
    acc = mix64(h[: len(h) - g + 1] + np.uint64(g))
    for d in range(1, g):
        acc = mix64(acc * np.uint64(0x2545F4914F6CDD1D) + h[d : len(h) - g + 1 + d])
    return acc


def cgk_keys(words: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 3) -> np.ndarray:
    """LSH entries (rows: windows, columns: repeats) of the windows words[at : at + size]."""
    rng = np.random.default_rng(seed)
    salts, where = rng.integers(0, 1 << 63, REPEATS, dtype=np.int64).astype(np.uint64), rng.random((REPEATS, SAMPLES))
    steps = 2 * int(size.max())
    i = np.zeros((len(at), REPEATS), np.int64)
    trail = np.empty((steps, len(at), REPEATS), np.int32)
    padded = np.concatenate([words, [_END]])
    for j in range(steps):
        trail[j] = i
        inside = i < size[:, None]
        c = padded[np.where(inside, np.minimum(at[:, None] + i, len(words)), len(words))]
        i += (mix64((c ^ salts) + np.uint64(j * 0x632BE5AB)) & np.uint64(1)).astype(np.int64) * inside
    out = np.zeros((len(at), REPEATS), np.uint64) + salts
    column = np.arange(REPEATS)
    for m in range(SAMPLES):
        step = (where[:, m][None, :] * 2 * size[:, None]).astype(np.int64)
        i = trail[step, np.arange(len(at))[:, None], column[None, :]]
        c = padded[np.where(i < size[:, None], np.minimum(at[:, None] + i, len(words)), len(words))]
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + c)
    return out


def best_alignment(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the window of text nearest to item in edits, if within `most`; the first such."""
    if np.isin(item, text).sum() < len(item) - most:
        return None
    cost, origin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    column = np.arange(len(text) + 1)
    for k, w in enumerate(item):
        swap, drop = np.concatenate([[k + 1], cost[:-1] + (text != w)]), cost + 1
        new = np.minimum(swap, drop)
        frm = np.where(swap <= drop, np.concatenate([[0], origin[:-1]]), origin)
        # Insertions: each cell may take the best of those before it, one more for each step.
        lead = new - column
        run = np.minimum.accumulate(lead)
        src = np.maximum.accumulate(np.where(lead == run, column, 0))
        cost, origin = run + column, frm[src]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def index_items(items: list[tuple], rate: float) -> dict:
    """Arrays to look up windows and candidates; items: (item_id, text)."""
    texts = [(x or "").encode() for _, x in items]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids, words, runs, keys = [], [], {}, []
    for (item, _), (h, _, _) in zip(items, hashed_words(data, offsets), strict=True):
        if not len(h):
            continue
        k, n = int(rate * len(h)), len(h)
        g = next((g for g in (4, 3, 2, 1) if n - g + 1 > g * k), 1) if k else min(4, n)
        ids.append(item)
        words.append(h)
        x = grams(h, g)
        runs.setdefault(g, []).append((x, np.arange(len(x)), np.full(len(x), n)))
        keys.append(cgk_keys(h, np.array([0]), np.array([n]))[0])
    table = {}
    for g, r in runs.items():
        x, o, n = (np.concatenate(c) for c in zip(*r, strict=True))
        order = np.lexsort((n, o, x))
        x, o, n = x[order], o[order], n[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (o[1:] != o[:-1]) | (n[1:] != n[:-1])])
        table[g] = x[new], o[new], n[new]
    flat, who = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.repeat(np.arange(len(keys)), REPEATS)
    order = np.lexsort((who, flat))
    return {"ids": ids, "words": words, "runs": table, "keys": flat[order], "who": who[order], "rate": rate}


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for every position in lo[row]..hi[row]-1."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def find(words: np.ndarray, index: dict, block: int = 512) -> list[tuple[int, int, int, int]]:
    """(item number, distance, first word, end word) of one text's best window for each item found."""
    places = []
    for g, (run, offset, size) in index["runs"].items():
        if len(words) < g:
            continue
        x = grams(words, g)
        lo = np.searchsorted(run, x)
        hit = np.flatnonzero(run[np.minimum(lo, len(run) - 1)] == x)
        row, at = _spread(lo[hit], np.searchsorted(run, x[hit], "right"))
        places.append(np.stack([np.maximum(hit[row] - offset[at], 0), size[at]], 1))
    spots = np.unique(np.concatenate(places), axis=0) if places else np.zeros((0, 2), np.int64)
    best, tried = {}, set()
    for a in range(0, len(spots), block):
        at, size = spots[a : a + block, 0], spots[a : a + block, 1]
        keys = cgk_keys(words, at, size)
        lo = np.searchsorted(index["keys"], keys)
        same = index["keys"][np.minimum(lo, len(index["keys"]) - 1)] == keys
        w, r = np.nonzero(same)
        row, pos = _spread(lo[w, r], np.searchsorted(index["keys"], keys[w, r], "right"))
        for window, who in sorted(set(zip(w[row].tolist(), index["who"][pos].tolist(), strict=True))):
            item = index["words"][who]
            k = int(index["rate"] * len(item))
            lo_, hi_ = max(0, int(at[window]) - k), min(len(words), int(at[window]) + len(item) + k)
            if (who, lo_) in tried:
                continue
            tried.add((who, lo_))
            if got := best_alignment(item, words[lo_:hi_], k):
                found = got[0], lo_ + got[1], lo_ + got[2]
                if who not in best or found < best[who]:
                    best[who] = found
    return [(who, *x) for who, x in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, block: int):
    """(whether it is the last, index) for each block of items; one is made at a time."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        yield k == n - 1, index_items(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end): for each row of docs and item found in it, the best window.

    An item is found where some window's word edit distance is at most rate * its words (rounded down).  Words are
    lower-cased (A-Z).  start and end are code points in the text.  Null and empty texts and items match nothing; very
    long texts are read whole; of equally near windows the first is reported; equal rows of docs are reported each;
    without documents or items there are no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, item_words int, start int, `end` int"
    parts = []
    for last, index in _blocks(benchmark, item_col, item_text_col, rate, block):
        shared = spark.sparkContext.broadcast(index)
        found = plain.mapInArrow(_matcher(shared), schema)
        if not last:
            found = cut(found, "decontam-found")
            shared.destroy()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _matcher(shared):
    def run(batches):
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            rows, got = [], []
            for k, (h, s, e) in enumerate(hashed_words(data, offsets)):
                for who, distance, a, b in find(h, index):
                    base = int(offsets[k])
                    start = len(data[base : s[a]].tobytes().decode())
                    rows.append(k)
                    got.append((index["ids"][who], distance, len(index["words"][who]), start, start + len(data[s[a] : e[b - 1]].tobytes().decode())))
            columns = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (None if got else pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]], ["doc_id", "item_id", "distance", "item_words", "start", "end"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", block: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in whose text no item is found (see matches); all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    where = docs.columns.index(text_col)
    for last, index in _blocks(benchmark, "item_id", "text", rate, block):
        shared = spark.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_cleaner(shared, where), docs.schema)
        if not last:
            docs = cut(docs, "decontam-kept")
            shared.destroy()
    return docs


def _cleaner(shared, where: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(where))
            yield batch.filter(pa.array([not find(h, shared.value) for h, _, _ in hashed_words(data, offsets)], pa.bool_()))

    return run

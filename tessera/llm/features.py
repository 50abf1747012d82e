"""Statistics of whole texts that the quality rules use, computed for many texts at once."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_bytes, hashed_words, mix64, small_batches

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("r_symbols", "r_upper", "r_digit", "r_marks", "r_dup_lines", "r_repeat", "r_distinct", "mean_word", "r_short", "words_a_line", "r_upto3")
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?;:~^_=+{}[]\\/@")] = True


def repeated_words(h: np.ndarray, n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more."""
    if len(h) < n + 1:
        return 0
    acc = h[: len(h) - n + 1].copy()
    for d in range(1, n):
        acc = mix64(acc * np.uint64(0x2545F4914F6CDD1D) + h[d : len(h) - n + 1 + d])
    order = np.argsort(acc, kind="stable")
    same = acc[order][1:] == acc[order][:-1]
    hit = np.zeros(len(acc), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(h), bool)
    for d in range(n):
        cover[d : d + len(hit)] |= hit
    return int(cover.sum())


def text_stats(raw: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[float]:
    """BASE counts, then RATIOS, of one text: its bytes, and its words' hashes and positions in these bytes."""
    n = len(h)
    points = np.cumsum((raw & 0xC0) != 0x80)
    lead = np.concatenate([[0], points])
    lengths = lead[ends] - lead[starts] if n else np.zeros(0, np.int64)
    word_chars = int(lengths.sum())
    symbols = int(_SYMBOL[raw].sum())
    breaks = np.flatnonzero(raw == 10)
    lo, hi = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    at = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    full = np.flatnonzero(at[1] > at[0])
    seen, dup, data = set(), 0, raw.tobytes()
    for k in full:
        line = data[lo[k] : hi[k]]
        dup += line in seen
        seen.add(line)
    repeat = repeated_words(h)
    size, some = max(1, len(raw)), max(1, n)
    ratios = [
        symbols / some, _UPPER[raw].sum() / size, _DIGIT[raw].sum() / size, _MARK[raw].sum() / size, dup / max(1, len(full)), repeat / some,
        len(np.unique(h)) / some, word_chars / some, float((lengths <= 1).sum()) / some, n / max(1, len(full)), float((lengths <= 3).sum()) / some,
    ]
    return [n, word_chars, symbols, dup, repeat, *map(float, ratios)]


def with_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, BASE as long and RATIOS as double, for whole texts, very long ones included.

    A null or empty text has counts and shares of 0; every row gives a row, repeated ones alike; an empty table gives an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in BASE] + [f"{c} double" for c in RATIOS])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(len(keep)))
            rows = [text_stats(data[a:b], h, s - a, e - a) for (h, s, e), a, b in zip(hashed_words(data, offsets, lower=False), offsets[:-1], offsets[1:], strict=True)]
            got = np.array(rows, float).reshape(len(rows), len(BASE) + len(RATIOS))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(got[:, i].astype(np.int64)) for i in range(len(BASE))], *[pa.array(got[:, len(BASE) + i]) for i in range(len(RATIOS))]], names=[*keep, *BASE, *RATIOS])

    return kept.mapInArrow(run, schema)

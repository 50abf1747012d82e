"""Near copies in crowds: components against brute force."""

import numpy as np

from tessera.llm import neardup


def _crowd(rng, n, changes, size=200):
    base, out = rng.integers(0, 10**6, size), []
    for _ in range(n):
        w = base.copy()
        w[rng.choice(size, changes, replace=False)] = rng.integers(0, 10**6, changes)
        out.append(" ".join(f"w{x}" for x in w))
    return out


def _brute(texts, n=4, percent=80):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in map(str.split, texts)]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[g] for g in s]] = 1
    both, size, label = held @ held.T, held.sum(1), np.arange(len(sets))
    linked = 100 * both >= percent * (size[:, None] + size - both)
    while True:
        new = np.where(linked, label, len(sets)).min(1)
        if (new == label).all():
            return label
        label = new


def test_crowds_are_compared_whole(spark):
    """Most pairs of the crowd are just too far apart; each partner has one near text, which may stand anywhere in it."""
    rng = np.random.default_rng(5)
    texts = _crowd(rng, 2000, 4)
    for i in range(0, 2000, 5):
        w = texts[i].split()
        for k in range(5):
            w[int(rng.integers(0, 200))] = f"p{i}x{k}"
        texts.append(" ".join(w))
    want = _brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_pairs_in_one_crowd(spark):
    """Pairs of near copies around one base: texts share enough to be one crowd, but only those of a pair are linked."""
    rng, texts = np.random.default_rng(7), []
    base = [f"b{i}" for i in range(200)]
    for p in range(400):
        w = list(base)
        for k in rng.choice(200, 9, replace=False):
            w[k] = f"p{p}x{k}"
        texts.append(" ".join(w))
        for k in rng.choice(200, 3, replace=False):
            w[k] = f"q{p}x{k}"
        texts.append(" ".join(w))
    want = _brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()}
    assert len(set(want)) > 300 and [got[i] for i in range(len(texts))] == want.tolist()


def test_joining():
    rng = np.random.default_rng(6)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 93, replace=False), rng.integers(10**6, 10**9, 7).astype(np.uint64)])) for _ in range(150)]
    linked = np.array([[100 * len(np.intersect1d(u, v)) >= 80 * len(np.union1d(u, v)) for v in sets] for u in sets])
    everything, group = np.arange(150), np.arange(150)
    edges = neardup.joining(sets, group, everything, everything, 80)
    assert edges and all(linked[i, j] for i, j in edges)
    for i, j in edges:
        group[group == group[i]] = group[j]
    assert all(group[i] == group[j] for i, j in zip(*np.nonzero(linked), strict=True))

"""MinHash near-duplicates over an LSH forest.

Documents with equal shingle sets are one node.  A node's MinHash labels are split into TREES strings of DEPTH labels;
each tree is a sorted order of the nodes by their string.  Candidates are neighbours in a sorted order, longest common
prefix first, and the first node of every region (run of equal prefixes) at each depth from LEAST up: the denser a
region, the deeper the prefix that its neighbours share, and the number of candidates stays linear in its size.  Every
link is confirmed on the full shingle sets.  Confirmation runs in two rounds: each node's likeliest candidate first, and
then those candidates that components do not join already, which gives the components of all confirmed candidates.

A region at depth LEAST of more nodes than neighbours cover is a crowd.  In a third round every pair of a crowd that
components do not join already is compared on the full sets, in blocks of chunks of the crowd, so the result is the
components of all pairs that share a region, whatever the number of partitions.
"""

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_bytes, cut, hashed_words, mix64, passing, shingles, small_batches

TREES, DEPTH, LEAST, NEAR = 16, 8, 4, 3
#: Of 128 one-bit labels, how many must agree for a candidate: five standard deviations below what a similarity of 0.8 gives.
AGREE = 98
#: A chunk of a crowd holds about CHUNK shingles, a node counting as SMALL at least: 1024 nodes at most.
CHUNK, SMALL = 1 << 18, 1 << 8


def fingerprint(u: np.ndarray) -> bytes:
    """16 bytes that name a shingle set."""
    return np.array([u.sum(), mix64(u + np.uint64(len(u))).sum()], np.uint64).tobytes()


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, fp, sig): fp names the shingle set (16 bytes, null if empty), sig holds its MinHash labels."""
    small_batches(docs.sparkSession)
    rng = np.random.default_rng(11)
    k = TREES * DEPTH
    flips, factors = rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            sizes, fps, sigs = [], [], []
            for h, _, _ in hashed_words(data, offsets):
                u = shingles(h, n)
                sizes.append(len(u))
                if not len(u):
                    fps.append(None)
                    sigs.append(None)
                    continue
                fps.append(fingerprint(u))
                low = (u >> np.uint64(32)).astype(np.uint32)
                least = np.full(k, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(low), 2048):
                    part = (low[at : at + 2048, None] ^ flips) * factors
                    np.minimum(least, part.min(0), out=least)
                sigs.append(least.astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, fp binary, sig binary")


def _prefix_lengths(labels: np.ndarray) -> np.ndarray:
    """Common prefix, in labels, of each row with the one before it; 0 for the first.  Column 0 is the tree."""
    if not len(labels):
        return np.zeros(0, np.int64)
    same = labels[1:] == labels[:-1]
    depth = np.cumprod(same, axis=1).sum(1) - 1
    return np.concatenate([[0], np.maximum(depth, 0)])


def forest_candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree) with a < b: candidate pairs of fps, each once, and how many one-bit labels agree; and (key, fp): the
    nodes of every crowd, a region at depth LEAST in which neighbours do not cover all pairs."""
    spark = nodes.sparkSession
    width, root = 4 * DEPTH, 1 + 4 * LEAST

    def plant(batches):
        import pyarrow as pa

        for batch in batches:
            fps, sigs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bits = np.packbits(np.frombuffer(b"".join(sigs), ">u4").reshape(len(sigs), -1).astype(np.uint32) & 1, axis=1) if sigs else []
            rows = [(bytes([t]) + s[t * width : (t + 1) * width], f, b.tobytes()) for f, s, b in zip(fps, sigs, bits, strict=True) for t in range(TREES)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*rows, strict=True) if rows else ((), (), ()))], ["key", "fp", "bits"])

    def walk(batches):
        import pyarrow as pa

        # told: how many nodes of the region have been seen; held: those of a region that may yet become a crowd.
        last, lead, region, told, held = [], {}, None, 0, []

        def take(batch):
            nonlocal region, told, held
            keys, fps, bits = (batch.column(i).to_pylist() for i in range(3))
            labels = np.empty((len(keys) + len(last), DEPTH + 1), np.int64)
            whole = [r[0] for r in last] + keys
            flat = np.frombuffer(b"".join(x[1:] for x in whole), ">u4").reshape(len(whole), DEPTH)
            labels[:, 1:], labels[:, 0] = flat, [x[0] for x in whole]
            common = _prefix_lengths(labels)
            pairs, crowd = [], []
            rows = list(zip(keys, fps, bits, strict=True))
            everything = last + rows
            base = len(last)
            for i, row in enumerate(rows):
                here = base + i
                c = int(common[here]) if here else 0
                if row[0][:root] != region:
                    region, told, held = row[0][:root], 0, []
                told += 1
                held.append(row[1])
                if told > NEAR + 1:
                    crowd.extend((region, f) for f in held)
                    held = []
                for d in range(LEAST, DEPTH + 1):
                    if c < d:
                        lead[d] = row
                if c >= LEAST:
                    shared = c
                    for back in range(1, NEAR + 1):
                        if here - back < 0 or shared < LEAST:
                            break
                        pairs.append((everything[here - back], row))
                        shared = min(shared, int(common[here - back]))
                    pairs.extend((lead[d], row) for d in range(LEAST, c + 1) if d in lead)
            last[:] = everything[-NEAR - 1 :]
            return pairs, crowd

        def out(pairs, crowd):
            got = {}
            for x, y in pairs:
                if x[1] != y[1]:
                    a, b = (x, y) if x[1] < y[1] else (y, x)
                    got[a[1], b[1]] = (a[2], b[2])
            if got:
                agree = 128 - np.unpackbits(np.frombuffer(b"".join(a for a, _ in got.values()), np.uint8) ^ np.frombuffer(b"".join(b for _, b in got.values()), np.uint8)).reshape(len(got), -1).sum(1)
            keep = [(k, int(n)) for k, n in zip(got, agree, strict=True) if n >= AGREE] if got else []
            none = [None] * len(crowd)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in keep] + [f for _, f in crowd], pa.binary()), pa.array([k[1] for k, _ in keep] + none, pa.binary()), pa.array([n for _, n in keep] + none, pa.int32()), pa.array([None] * len(keep) + [k for k, _ in crowd], pa.binary())],
                ["a", "b", "agree", "key"],
            )

        for batch in batches:
            if batch.num_rows:
                yield out(*take(batch))

    planted = nodes.select("fp", "sig").mapInArrow(plant, "key binary, fp binary, bits binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # A region lies in one partition, so no pair depends on how many there are.
    ordered = planted.repartition(parts, F.substring("key", 1, root)).sortWithinPartitions("key", "fp")
    found = cut(ordered.mapInArrow(walk, "a binary, b binary, agree int, key binary"), "forest")
    pairs = found.filter("key is null").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    return pairs, found.filter("key is not null").select("key", F.col("a").alias("fp"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, members): the sorted full shingle sets of wanted (fp, least): the documents with these least ids.

    docs: (doc_id, text).  A bit map of fixed size keeps most other texts out of the shuffle.
    """
    small_batches(docs.sparkSession)

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            all_sets = [shingles(h, n) for h, _, _ in hashed_words(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(u) for u in all_sets], pa.binary()), pa.array([u.tobytes() for u in all_sets], pa.binary())], ["fp", "members"])

    ids = cut(wanted.select("least", F.xxhash64("least").alias("_k")).distinct(), "set-ids")
    passed = docs.withColumn("_k", F.xxhash64("doc_id")).filter(passing(ids, "_k"))
    texts = passed.join(ids.hint("merge"), "_k", "left_semi").select("text")
    # Repeated rows give equal sets; they are made one before any join.
    return cut(texts.mapInArrow(sets, "fp binary, members binary").dropDuplicates(["fp"]), "members")


def confirm(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(x, y) of those pairs (a, b, x, y) whose full shingle sets a, b have 100 * intersection >= percent * union."""

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                u, v = (u, v) if len(u) <= len(v) else (v, u)
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    # Sets are long: their size on disk says little, so they are never broadcast.
    left = pairs.join(members.select(F.col("fp").alias("a"), F.col("members").alias("ma")).hint("merge"), "a")
    both = left.join(members.select(F.col("fp").alias("b"), F.col("members").alias("mb")).hint("merge"), "b").select("x", "y", "ma", "mb")
    return both.mapInArrow(meet, "x binary, y binary")


def joining(sets: list[np.ndarray], group: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (row, column) at the threshold that join all groups which any such pair joins; each joins two groups."""
    size, group, edges = np.array([len(u) for u in sets]), group.copy(), []
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of many holders are columns of a dense product, the others are counted along their postings.  There are
    # 16 columns at most for each shingle that a set has on average, so the product's size follows that of the sets.
    thick = holders > max(len(sets) // 16, 1)
    held = np.zeros((len(sets), int(thick.sum())), np.float32)
    at = thick[token]
    held[owner[at], (np.cumsum(thick) - 1)[token[at]]] = 1
    thin = ~at & (holders > 1)[token]
    owner, token = owner[thin], token[thin]
    order = np.argsort(token, kind="stable")
    posted, first = owner[order], np.searchsorted(token[order], np.arange(len(holders) + 1))
    own, across = np.searchsorted(owner, np.arange(len(sets) + 1)), held[columns].T
    for lo in range(0, len(rows), 256):
        some = rows[lo : lo + 256]
        for i, both in zip(some, (held[some] @ across).astype(np.int64), strict=True):
            mine = token[own[i] : own[i + 1]]
            if len(mine):
                n = first[mine + 1] - first[mine]
                both += np.bincount(posted[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))[columns]
            hit = columns[(100 * both >= percent * (size[i] + size[columns] - both)) & (group[columns] != group[i])]
            if len(hit):
                met, where = np.unique(group[hit], return_index=True)
                edges.extend((int(i), int(j)) for j in hit[where])
                group[np.isin(group, met)] = group[i]
    return edges


def crowd_links(crowds: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of labels that join all labels which any confirmed pair of a crowd joins.  crowds: (key, fp, label, size)."""

    def meet(table):
        import pyarrow as pa

        side, labels = np.array(table["side"]), table["label"].to_pylist()
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in table["members"]]
        _, group = np.unique(np.array([m.hex() for m in labels]), return_inverse=True)
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(columns):
            # A chunk with itself: every pair of two groups has a node outside the largest one.
            rows, columns = np.flatnonzero(group != np.bincount(group).argmax()), np.arange(len(labels))
        edges = joining(sets, group, rows, columns, percent) if len(rows) else []
        return pa.table({"x": pa.array([labels[i] for i, _ in edges], pa.binary()), "y": pa.array([labels[j] for _, j in edges], pa.binary())})

    # A label of a chunk's size or more has chunks of its own; smaller labels share chunks.  Only sums are gathered, so
    # no crowd is ever in one task, and chunks of a large component meet no chunk of the same.
    weighed = crowds.withColumn("w", F.greatest("size", F.lit(SMALL)))
    labels = cut(weighed.groupBy("key", "label").agg(F.sum("w").alias("own")), "crowd-labels")
    shared = labels.filter(F.col("own") < CHUNK).groupBy("key").agg(F.sum("own").alias("shared"))
    several = lambda of, total: F.xxhash64(F.lit(total), of, F.pmod(F.xxhash64("fp" if total == "own" else "label"), F.ceil(F.col(total) / CHUNK)))
    chunk = F.when(F.col("own") >= CHUNK, several(F.col("label"), "own")).otherwise(several(F.lit(0), "shared"))
    placed = cut(crowds.join(labels, ["key", "label"]).join(shared, "key", "left").select("key", "fp", "label", chunk.alias("chunk")), "chunks")
    chunks = cut(placed.groupBy("key", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "chunk-ends")
    x, y = (chunks.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("chunk", "lo", "hi")]) for k in "xy")
    blocks = x.join(y, "key").filter("chunkx <= chunky and not (lox = hix and loy = hiy and lox = loy)").select("key", "chunkx", "chunky")
    blocks = cut(blocks, "blocks")
    one = lambda c, side, some: placed.join(some, (placed["key"] == some["key"]) & (placed["chunk"] == some[c])).select(some["key"], "chunkx", "chunky", F.lit(side).alias("side"), "fp", "label")
    both = one("chunkx", 0, blocks).unionByName(one("chunky", 1, blocks.filter("chunkx < chunky")))
    filled = both.join(members.hint("merge"), "fp")
    return filled.groupBy("key", "chunkx", "chunky").applyInArrow(meet, "x binary, y binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of its component; only nodes with an edge.  edges: (x, y).

    Alternating large-star and small-star steps until nothing changes; each round is written to the shared folder and no
    neighbourhood is ever gathered in one place - minima are aggregates and come back by a join.
    """
    now, before = cut(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "cc"), None
    for k in count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: b's smaller neighbours, and b itself, hang below the smallest of them.
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(floor, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y")
        now = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"cc-{k}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) with the groups joined that links (x, y: labels, or nodes without one) join.

    Only groups with a new link are looked at, so these components have few rounds on a small graph.
    """
    if links.isEmpty():
        return label
    more = components(links).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = label.join(more, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    bare = more.join(label, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return cut(known.unionByName(bare), "merged")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id of its group) and kept (it is that id).

    Texts are split into words and lower-cased (A-Z); a set is the distinct n-word shingles, of fewer words the whole
    sequence.  Null texts and texts without words have no shingles and are alone.  Equal sets are linked.  Null ids count
    as larger than any; rows that share an id are one document to `kept`; an empty table gives an empty result; other
    columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = cut(signatures(docs, n, id_col, text_col), "signatures")
    nodes = rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    nodes = cut(nodes, "nodes")
    pairs, crowds = forest_candidates(nodes)
    pairs = cut(pairs, "candidates")
    holders = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    in_pairs = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(crowds.select("fp")).distinct()
    members = shingle_sets(holders, nodes.select("fp", "least").join(in_pairs, "fp", "left_semi"), n)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    label = components(cut(confirm(best.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), members, percent), "links-1"))
    named = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    rest = cut(rest.select("a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).filter("x <> y"), "rest")
    label = merged(label, cut(confirm(rest, members, percent), "links-2"))
    placed = crowds.join(nodes.select("fp", "size"), "fp").join(label, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("label", "fp").alias("label"), "size")
    placed = cut(placed, "crowds")
    # Crowds of one label are settled, and trees with the same crowd need it once.
    same = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark")).filter("lo <> hi")
    open_crowds = cut(same.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key"), "open")
    if not open_crowds.isEmpty():
        label = merged(label, cut(crowd_links(placed.join(open_crowds, "key", "left_semi"), members, percent), "links-3"))
    joined = cut(nodes.select("fp", "least").join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    smallest = joined.groupBy("label").agg(F.min("least").alias("component"))
    members = joined.join(smallest, "label").select(F.col("fp").alias("_fp"), "component")
    out = rows.select("doc_id", "n_shingles", "fp").join(members, F.col("fp") == F.col("_fp"), "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


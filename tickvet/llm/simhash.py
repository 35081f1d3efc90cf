"""SimHash near-duplicates by sharded vantage-point trees.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of the text's 3-word shingles. Fingerprints at most
3 bits apart link. By the pigeonhole principle two such fingerprints differ in at most one bit of their upper or of their
lower half, so each half is searched with radius 1 in a vantage-point tree and every hit is verified on all 64 bits.

A top tree is built on a bounded sample of the distinct fingerprints; its leaves are shards. Every fingerprint is kept in
one shard by its distances to the vantage points; as a query it also visits each shard that the triangle inequality
cannot exclude (distance within the radius of the border), so every link is seen in the kept fingerprint's shard. Within
a shard a tree over the kept half values answers all queries at once. A shard reports a spanning forest of its links, never all pairs of a
group; connected components then come from iterated minimum labels with pointer jumping on these edges, cut by
materialised tables.

Edge cases: null text counts as empty; texts without words have fingerprint zero and link like any other; fewer than 3
words are one shingle; repeated rows and ids are harmless (labels are minima; a null id counts as no id, and a component of
null ids only has a null component_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import materialize, shuffle_partitions, slices

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(flat)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[s:e], seed) for s, e in zip(starts, ends, strict=False)])
    count = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 16):
        count += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""

    def each(batches):
        for batch in slices(batches):
            fps = np.array([simhash(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fp long")


class VantageTree:
    """A tree over distinct values; leaves hold at most `leaf` of them (more only if no vantage point separates them)."""

    def __init__(self, values: np.ndarray, leaf: int, seed: int = 1):
        self.nodes: list[tuple] = []  # (vantage, border, inner, outer), or (None, leaf number, values)
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(np.unique(values), -1, 0)]
        while todo:
            held, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = here
            split = self._split(held, rng) if len(held) > leaf else None
            if split is None:
                self.nodes.append([None, self.leaves, held])
                self.leaves += 1
            else:
                vantage, border, inner = split
                self.nodes.append([vantage, border, -1, -1])
                todo += [(held[inner], here, 0), (held[~inner], here, 1)]

    @staticmethod
    def _split(held, rng):
        best = None
        for v in held[rng.integers(len(held), size=4)]:
            d = np.bitwise_count(held ^ v)
            for border in {int(np.median(d)), max(0, int(np.median(d)) - 1)}:
                inner = d <= border
                near = ((d > border - 1) & (d <= border + 1)).sum()  # those whose ball of radius 1 crosses the border
                uneven = abs(2 * int(inner.sum()) - len(held))
                if inner.any() and not inner.all() and (best is None or near + uneven < best[0]):
                    best = (near + uneven, v, border, inner)
        return best and best[1:]

    def visits(self, queries: np.ndarray, radius: int):
        """(leaf node, positions of the queries whose ball reaches it) for each leaf reached."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if not len(q):
                continue
            if node[0] is None:
                yield node, q
            else:
                d = np.bitwise_count(queries[q] ^ node[0]).astype(np.int16)
                todo += [(node[2], q[d <= node[1] + radius]), (node[3], q[d > node[1] - radius])]


def _halves(fp: np.ndarray, side: int) -> np.ndarray:
    fp = fp.view(np.uint64)
    return (fp >> np.uint64(32) if side == 0 else fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class _Forest:
    """Union-find that records the joins which matter."""

    def __init__(self, n: int):
        self.up, self.joined = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.joined.append((a, b))

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """As join() of each pair, without a Python step for each pair of a dense block."""
        for side in (a, b):
            for i in np.unique(side, return_index=True)[1].tolist():
                self.join(int(a[i]), int(b[i]))
        ends = np.unique(np.concatenate([a, b]))
        roots = np.array([self.root(i) for i in ends.tolist()], np.int64)
        ra, rb = roots[np.searchsorted(ends, a)], roots[np.searchsorted(ends, b)]
        apart = np.flatnonzero(ra != rb)
        for i in apart[np.unique(ra[apart] << 32 | rb[apart], return_index=True)[1]].tolist():
            self.join(int(a[i]), int(b[i]))

    def one(self, a: np.ndarray, b: np.ndarray) -> bool:
        first = self.root(int(a[0]))
        return all(self.root(i) == first for x in (a, b) for i in x.tolist())


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs; bitwise_count alone counts those of the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64))


class _ByHalf:
    """Fingerprints grouped by one half of theirs."""

    def __init__(self, fps: np.ndarray, side: int):
        self.halves, at = np.unique(_halves(fps, side), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.fps = fps[order]
        self.begin = np.searchsorted(at[order], np.arange(len(self.halves) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.fps[self.begin[i] : self.begin[i + 1]]


def shard_edges(kept: np.ndarray, queries: np.ndarray, side: int, radius: int, leaf: int = 64, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between kept fingerprints and queries (among them the kept): pairs of fingerprints."""
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.unique(queries)
    forest, own, asked = _Forest(len(every)), _ByHalf(np.unique(kept), side), _ByHalf(every, side)
    number = lambda fps: np.searchsorted(every, fps)
    tree = VantageTree(own.halves, leaf)
    for node, reached in tree.visits(asked.halves, radius // 2):
        place = np.searchsorted(own.halves, node[2])
        for some in np.array_split(reached, -(-len(reached) // 4096)):
            i, j = np.nonzero(np.bitwise_count(asked.halves[some][:, None] ^ node[2][None, :]) <= radius // 2)
            a, b = some[i], place[j]
            single = (np.diff(asked.begin)[a] == 1) & (np.diff(own.begin)[b] == 1)
            x, y = asked.fps[asked.begin[a[single]]], own.fps[own.begin[b[single]]]
            hit = (_apart(x, y) <= radius) & (x != y)
            forest.join_all(number(x[hit]), number(y[hit]))
            for p, q in zip(a[~single].tolist(), b[~single].tolist(), strict=True):
                ours, theirs = asked.of(p), own.of(q)
                for at in range(0, len(ours), block):
                    for bt in range(0, len(theirs), block):
                        x, y = ours[at : at + block], theirs[bt : bt + block]
                        if len(x) * len(y) > 64 and forest.one(number(x), number(y)):
                            continue  # linked already; further links between them change no component
                        u, v = np.nonzero((_apart(x[:, None], y[None, :]) <= radius) & (x[:, None] != y[None, :]))
                        if len(u):
                            forest.join_all(number(x[u]), number(y[v]))
    pairs = np.array(forest.joined, np.int64).reshape(-1, 2)
    return every[pairs[:, 0]], every[pairs[:, 1]]


def links(distinct: DataFrame, radius: int = 3, sample_rows: int = 20_000, shard_rows: int = 20_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) whose closure is that of all links within radius (odd)."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(min(sample_rows, n)).collect()], np.int64)
    shards = max(1, n // shard_rows)
    trees = [VantageTree(_halves(sample, s), max(64, len(sample) // shards)) if n else None for s in (0, 1)]
    held = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for side, tree in enumerate(held.value):
                half = _halves(fp, side)
                home = {}
                for node, q in tree.visits(half, 0):
                    home[node[1]] = q
                for node, q in tree.visits(half, radius // 2):
                    own = np.isin(q, home.get(node[1], q[:0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), node[1] * 2 + side), pa.int32()), pa.array(own), pa.array(fp[q])], ["shard", "kept", "fp"])

    def search(key, table):
        fp, kept = table.column("fp").to_numpy(), table.column("kept").to_numpy()
        a, b = shard_edges(fp[kept], fp, key[0].as_py() % 2, radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, kept boolean, fp long")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of an edge (a, b), the least node of its component."""
    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        # Each node knows the least node it touches; all its neighbours and itself are hooked on that one.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        hooked = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = materialize(hooked.filter("a > b").distinct())
        # Done when it is a forest of stars: each node has one edge, and none leads to a node that leads on.
        rows, nodes = pairs.agg(F.count("*"), F.countDistinct("a")).first()
        if rows == nodes and pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, sample_rows: int = 20_000, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, fp, component_id (the least id of those reachable by links) of every document."""
    prints = materialize(fingerprints(docs, width))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius, sample_rows, shard_rows))
    of = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def likely(of: DataFrame, prints: DataFrame, radius: int = 3, sample_rows: int = 20_000, shard_rows: int = 20_000) -> DataFrame:
    """(a, b): pairs of classes whose closure is that of all links of their fingerprints.

    of: (key, c), the class of every document; prints: (doc_id, fp) with the key as doc_id.
    """
    named = materialize(of.join(prints, of.key == prints.doc_id).select("fp", "c").distinct())
    heads = materialize(named.groupBy("fp").agg(F.min("c").alias("head")))
    head = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias("c" + side))
    same = named.join(heads, "fp").select(F.col("c").alias("a"), F.col("head").alias("b"))
    linked = links(heads, radius, sample_rows, shard_rows).join(head("a"), "a").join(head("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return same.unionByName(linked).filter("a <> b").distinct()


def keep_first(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, radius: int = 3) -> DataFrame:
    """Exactly one row of each group, that of the least id (of equal ids any, null ids last); all columns.

    Groups are those of Jaccard num/den over shingles. SimHash, of 3-word shingles as op10's, and its vantage-point trees propose links, at
    `radius` bits or fewer; each is verified on the whole sets. Similar texts whose fingerprints are further apart are found by the exact join (docjoin),
    among what is not linked yet. Rows are told apart by a number of their own, so repeated and null ids are rows like others.
    """
    from tickvet.llm import docjoin
    from tickvet.llm.linejoin import bitmap, maybe_in

    row = "row_" + "_".join(docs.columns)  # no column's name
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = materialize(fingerprints(numbered.select(F.col(row).alias("doc_id"), "text")))
    found = docjoin.groups(numbered, row, width, num, den, proposed=lambda of: likely(of, prints, radius))
    ids = numbered.select(F.col(row).alias("key"), F.col("doc_id").cast("long").alias("id"))
    placed = found.join(ids, "key").select("key", "root", F.struct(F.col("id").isNull(), "id", "key").alias("place"))
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    gone = materialize(placed.join(first, "root").filter("place <> first").select(F.col("key").alias(row)))
    # Only rows that may go are shuffled with their texts.
    near = maybe_in(bitmap(gone, row), F.col(row))
    stay = numbered.filter(near).join(gone, row, "left_anti")
    return numbered.filter(~near).select(*docs.columns).unionByName(stay.select(*docs.columns))

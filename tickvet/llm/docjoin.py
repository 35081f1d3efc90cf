"""Near-duplicate documents by an exact set-similarity join over word shingles.

A document is the set of its 5-word shingles (A-Z lower-cased, words as white space separates them; fewer words are one
shingle). Documents of a Jaccard similarity of num/den or more link; a group is what links connect. No pair is missed:

1. Documents of the same set are one class, named by a 64-bit hash of the set; the join is over classes.
2. Shingles are ordered by rarity (levels of their counts in all documents, by 2^20 buckets of hashes, then hash; any order is right,
   a good one is fast). A prefix is the n - ceil(n num/den) + 1 rarest of n; two similar sets share one of them. Prefixes are dealt to shards by
   shingle, and only shingles that several classes have there go on.
3. Pairs that the caller proposes (simhash.py: links of fingerprints) are verified first; what they settle is asked no more.
4. Star rounds verify each class with one likely partner, so a large group is settled by about one pair a class. The last
   round takes all pairs of unlike groups that share a shingle of both prefixes, drops those whose number of shared ones is too small for num/den
   (up to where the first of two prefixes ends, all shared shingles are in both), and verifies the rest on the whole sets.

Equal 64-bit hashes are taken for equal shingles and classes. Many documents that are all alike by somewhat less than num/den cost
a verification for each pair: no link settles them.

Edge cases: null text counts as empty; texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import discard, materialize, mix, slices, text_bytes, word_hashes, word_shingles
from tickvet.llm.linejoin import bitmap, maybe_in

def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (n * num + den - 1) // den + 1


PAIRS = "a long, b long, na int, nb int, shared long"


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row and hash, the row of each, and the class of each row."""
    h, row = word_hashes(*text_bytes(batch.column("text")), punctuation=False)
    s, of = word_shingles(h, row, batch.num_rows, width)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[first], of[first]
    n = np.bincount(of, minlength=batch.num_rows)
    total = np.zeros(batch.num_rows, np.uint64)
    if len(s):
        total[n > 0] = np.add.reduceat(mix(s), (np.cumsum(n) - n)[n > 0])
    return s, of, mix(total + n.astype(np.uint64)).view(np.int64)


def classes(docs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, c, n): class and number of shingles of every document; materialised."""

    def each(batches):
        for batch in slices(batches):
            _, of, c = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c), pa.array(np.bincount(of, minlength=batch.num_rows).astype(np.int32))], ["key", "c", "n"])

    return materialize(docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(each, "key long, c long, n int"))


def common_shingles(docs: DataFrame, width: int, buckets: int = 1 << 20) -> np.ndarray:
    """A level for each bucket of shingles (the low bits of their hash), from the bucket's count in all documents."""

    def each(batches):
        count = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            count += np.bincount((shingle_sets(batch, width)[0] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(count)
        for at in np.split(some, range(100_000, len(some), 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.select("bucket", F.floor(4 * F.log2("n")).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(buckets, np.uint8)
    levels[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    return levels


def met_prefixes(docs: DataFrame, width: int, num: int, den: int, common, shards: int) -> DataFrame:
    """(shard, token, c, n): the prefix shingles that several classes have; materialised."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    row = (("token", np.uint64), ("c", np.int64), ("n", np.int32))

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1)
        levels = held.value
        for batch in slices(batches):
            s, of, c = shingle_sets(batch, width)
            if not len(s):
                continue
            level = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
            order = np.lexsort((s, level, of))
            n = np.bincount(of, minlength=batch.num_rows)
            place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            take = place < prefix_size(n, num, den)[of]
            token, of = s[order][take], of[take]
            shard = (mix(token) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, token, of = shard[order], token[order], of[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            parts = np.split(np.arange(len(shard)), cuts[1:])
            data = {"token": token, "c": c[of], "n": n[of]}
            packed = [pack.compress(b"".join(data[k][p].astype(t).tobytes() for k, t in row)) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array([len(p) for p in parts], pa.int32()), pa.array(packed, pa.binary())], ["shard", "many", "rows"])

    def meet(key, table):
        parts = {k: [] for k, _ in row}
        for many, packed in zip(table.column("many").to_pylist(), table.column("rows").to_pylist(), strict=True):
            data, at = zstandard.decompress(packed), 0
            for k, t in row:
                parts[k].append(np.frombuffer(data, t, many, at))
                at += many * np.dtype(t).itemsize
        token, c, n = (np.concatenate(parts[k]) for k, _ in row)
        order = np.lexsort((c, token))
        token, c, n = token[order], c[order], n[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        token, c, n = token[first], c[first], n[first]
        _, group, size = np.unique(token, return_inverse=True, return_counts=True)
        some = size[group] > 1
        return pa.table({"shard": np.full(some.sum(), key[0].as_py(), np.int64), "token": token[some].view(np.int64), "c": c[some], "n": n[some]})

    dealt = docs.select("text").mapInArrow(deal, "shard long, many int, rows binary")
    return materialize(dealt.groupBy("shard").applyInArrow(meet, "shard long, token long, c long, n int"))


def _counted(c: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Pairs of classes with the number of times that each occurs; a and b are rows of c and n."""
    names, first, number = np.unique(c, return_index=True, return_inverse=True)
    code, shared = np.unique(number[a] * len(names) + number[b], return_counts=True)
    x, y = code // max(len(names), 1), code % max(len(names), 1)
    return pa.table({"a": names[x], "b": names[y], "na": n[first[x]].astype(np.int32), "nb": n[first[y]].astype(np.int32), "shared": shared.astype(np.int64)})


def _star(table: pa.Table, seed: int, num: int, den: int) -> pa.Table:
    """Each class with the least one, in a seed's order, of each shingle's classes; of a class's pairs the most frequent."""
    token, c, n, root = (table.column(k).to_numpy() for k in ("token", "c", "n", "root"))
    order = np.lexsort((mix(c.view(np.uint64) ^ np.uint64(seed)), token))
    token, c, n, root = token[order], c[order], n[order], root[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    centre = np.repeat(begin, np.diff(np.append(begin, len(token))))
    fits = np.flatnonzero((root != root[centre]) & (n * num <= n[centre] * den) & (n[centre] * num <= n * den))
    return _counted(c, n, fits, centre[fits])


def _all_pairs(table: pa.Table, num: int, den: int, most: int = 1 << 20):
    """All pairs of unlike groups and fitting lengths within each shingle's classes; tables of bounded size."""
    token, c, n, root = (table.column(k).to_numpy() for k in ("token", "c", "n", "root"))
    order = np.lexsort((n, token))
    token, c, n, root = token[order], c[order], n[order].astype(np.int64), root[order]
    _, group = np.unique(token, return_inverse=True)
    if len(token):  # shingles of one group only have nothing to add
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        group_roots = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        i = np.flatnonzero(group_roots[group])
    else:
        i = np.zeros(0, np.int64)
    k, held, out = 0, 0, []
    while len(i):
        k += 1
        i = i[i + k < len(n)]
        i = i[(token[i] == token[i + k]) & (n[i + k] * num <= n[i] * den)]
        some = i[root[i] != root[i + k]]
        swap = c[some] > c[some + k]
        out.append((np.where(swap, some + k, some), np.where(swap, some, some + k)))
        held += len(some)
        if held > most:
            yield _counted(c, n, *map(np.concatenate, zip(*out, strict=True)))
            held, out = 0, []
    if held:
        yield _counted(c, n, *map(np.concatenate, zip(*out, strict=True)))


def _search(seed: int | None, num: int, den: int):
    """The function of a shard: a star round of a seed, or all pairs."""

    def star(table):
        return _star(table, seed, num, den)

    def every(table):
        nothing = np.zeros(0, np.int64)
        return pa.concat_tables([_counted(nothing, nothing, nothing, nothing), *_all_pairs(table, num, den)])

    return every if seed is None else star


def _verified(docs: DataFrame, key: str, firsts: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose Jaccard similarity is num/den or more; materialised."""
    pairs = materialize(pairs)
    names = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = materialize(firsts.join(names, "c").select("key"))

    def each(batches):
        for batch in slices(batches):
            s, of, c = shingle_sets(batch, width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s.view(np.int64)))], ["key", "c", "h"])

    bits = bitmap(wanted, "key")
    near = docs.select(F.col(key).cast("long").alias("key"), "text").filter(maybe_in(bits, F.col("key")))
    sets = materialize(near.mapInArrow(each, "key long, c long, h array<long>").join(wanted, "key", "left_semi").select("c", "h"))
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("c").alias("b"), F.col("h").alias("hb")), "b")
    similar = F.size(F.array_intersect("ha", "hb")) * (num + den) >= (F.size("ha") + F.size("hb")) * num
    out = materialize(both.filter(similar).select("a", "b"))
    discard(pairs, wanted, bits, sets)
    return out


def groups(docs: DataFrame, key: str = "doc_id", width: int = 5, num: int = 4, den: int = 5, shard_rows: int = 250_000, stars: int = 2, proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, root): the group of every document; materialised. key: a column of distinct longs.

    proposed: from (key, c), the class of every document, to pairs (a, b) of classes to verify before any others.
    """
    from tickvet.llm.simhash import components

    of = classes(docs, key, width)
    shingles = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = common_shingles(docs, width)
    met = met_prefixes(docs, width, num, den, common, max(1, shingles * (den - num) // den // shard_rows + 1))
    firsts = materialize(of.groupBy("c").agg(F.min("key").alias("key")))
    edges = [_verified(docs, key, firsts, proposed(of), width, num, den)] if proposed else []
    roots = components(edges[0]) if edges else None
    for turn in range(stars + 1):
        named = met.withColumn("root", F.col("c")) if roots is None else met.join(roots, met.c == roots.node, "left").select(*met.columns, F.coalesce("root", "c").alias("root"))
        search = _search(turn if turn < stars else None, num, den)
        found = named.groupBy("shard").applyInArrow(search, PAIRS).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
        if turn < stars:
            found = found.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("y")).select("a", "y.b")
        else:
            least = lambda n: F.expr(f"{n} - ({n} * {num} + {den - 1}) div {den} + 1 - ({n} - ((na + nb) * {num} + {num + den - 1}) div {num + den})")
            found = found.filter(F.col("shared") >= F.least(least("na"), least("nb"))).select("a", "b")
        edges.append(_verified(docs, key, firsts, found, width, num, den))
        links = edges[0]
        for more in edges[1:]:
            links = links.unionByName(more)
        roots = components(links)
    return materialize(of.join(roots, of.c == roots.node, "left").select("key", F.coalesce("root", "c").alias("root")))

"""Exact Jaccard join of documents as points of a metric space: pivots, Voronoi cells, triangle windows, recursion.

A document is the set of its 3-word shingles (A-Z lower-cased, words as white space separates them; fewer words are one
shingle). The Jaccard distance 1 - both / either is a metric; two documents link at a distance of r = 1 - num/den or less.

1. Equal sets are one class; the join is over classes.
2. In whole-set distance most documents are 1 away from any document, and no pivot tells them apart. So the first pivots are restrictions to
   parts of the shingle universe. Two linking sets differ in e = floor((na + nb) (den - num) / (den + num)) shingles at most; where the
   universe is cut by hash into more than e parts, they are equal on one of them: at distance 0 from the same pivot. A cell is a part and a
   restriction to it (some eight shingles). Lengths are cut into bands of a ratio num/den; a set is in the cells of its band with the next and with
   the one before, so every pair that can link has the same parts somewhere. Empty restrictions are left out where enough others are there. Cells of one class have no pairs.
3. Star rounds: the members of each cell are compared with one pivot out of it (of the least hash, the same in all cells, so that cells of alike
   documents share pivots). That settles large groups of near copies by about one pair a class; a cell of one component is done.
4. Of the others, a cell of more than `leaf` classes is split by document pivots out of it (the least of `pivots` hash buckets). Distances to them are exact, where
   length and bitmap do not show them to be far. With D the distance to the nearest pivot and t = 3r, a class of D <= t has that pivot's Voronoi
   cell as home, others the cell of the rest. By the triangle inequality a partner of a class at home with p is within min(its D + 2r, t + r)
   of p: in all such windows a class is replicated. So each linking pair meets in a cell, which is split again if it is still large.
5. Cells of `leaf` classes or fewer, and those that a split left nearly whole, are joined: pairs of unlike components that pass the
   length window, the window |d(a, p) - d(b, p)| <= r of their pivot and the parity bitmap (bits that differ are at most
   the shingles of one set only). Near copies share hundreds of cells: a pair is left to the least of these if it is among the
   16 least cells of both (then so is any lesser one that they share).
6. Pairs, of stars too, are verified on the whole sets, which are made once, for the classes that meet another only.

Regions are keys of shuffles; nothing of a cell is held by one task but the rows of a sorted join, which Spark splits if they are skewed.
Many documents alike by somewhat less than num/den cost a verification for each pair that passes the filters: no link settles them.
A set (8 bytes a shingle) is held whole by a task: some 20 times a text's bytes while it is made.

Equal 64-bit hashes are taken for equal shingles and classes (by chance once in some 10^9 classes).

Edge cases: texts that are null or have no words have the empty set, which links with nothing, not even with another; repeated
rows and equal texts are one class; rows of equal ids are rows of their own; a null id counts as no id, and a component of null ids only has a null component_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import discard, materialize, mix, slices
from tickvet.llm.docjoin import shingle_sets
from tickvet.llm.linejoin import bitmap, maybe_in
from tickvet.llm.simhash import components

SKETCH = [f"s{i}" for i in range(4)]
EPS = 1e-9  # windows are wider by it; links are decided in whole numbers


def _sketch(s: np.ndarray, of: np.ndarray, rows: int) -> list[np.ndarray]:
    """Four words of 64 bits by row: a bit is the parity of the number of shingles that fall on it."""
    at = mix(s ^ np.uint64(0x2545F4914F6CDD1D))
    word, bit = at & np.uint64(3), np.uint64(1) << ((at >> np.uint64(2)) & np.uint64(63))
    n = np.bincount(of, minlength=rows)
    begin, out = (np.cumsum(n) - n)[n > 0], []
    for w in range(4):
        bits = np.zeros(rows, np.uint64)
        if len(s):
            bits[n > 0] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), begin)
        out.append(bits.view(np.int64))
    return out


def _band_width(num: int, den: int) -> float:
    return math.log(den / num) * (1 + EPS)


def _cells(s: np.ndarray, of: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """First cells by row, and how many each row has. s: distinct shingles of rows `of`, n of each row."""
    width, rows = _band_width(num, den), len(n)
    band = np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64)
    value, place = mix(s), mix(s ^ np.uint64(0x632BE59BD9B4E019))
    out, out_row = [], []
    for level in (band, band - 1):  # bands level and level + 1 meet
        longest = np.ceil(np.exp(width * (level + 2)))
        e = np.where(n > 0, np.floor(2 * longest * (den - num) / (den + num)), 0).astype(np.int64)
        parts = np.where(e > 0, e + 2 + e // 64, 0)  # e = 0: only equal sets link
        begin = np.cumsum(parts) - parts
        mine = np.flatnonzero(e[of] > 0)
        at = begin[of[mine]] + (place[mine] % parts[of[mine]].astype(np.uint64)).astype(np.int64)
        total, many = np.zeros(parts.sum(), np.uint64), np.bincount(at, minlength=parts.sum())
        np.add.at(total, at, value[mine])
        row = np.repeat(np.arange(rows), parts)
        part = np.arange(len(row)) - begin[row]
        full = np.bincount(row[many > 0], minlength=rows)
        keep = (many > 0) | (full <= e)[row]  # more full parts than e: one of the equal ones is full
        name = mix((level[row] + 1).astype(np.uint64) << np.uint64(40) | part.astype(np.uint64))
        out.append(mix(total + mix(many.astype(np.uint64)) ^ name)[keep])
        out_row.append(row[keep])
    cell, row = np.concatenate(out), np.concatenate(out_row)
    return cell[np.argsort(row, kind="stable")].view(np.int64), np.bincount(row, minlength=rows)


def prints(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, c, n, s0..s3, cells) of every document: class, set size, bitmap, first cells; materialised."""

    def each(batches):
        for batch in slices(batches):
            s, of, c = shingle_sets(batch, width)
            n = np.bincount(of, minlength=batch.num_rows)
            cells, many = _cells(s, of, n, num, den)
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(cells))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c), pa.array(n.astype(np.int64)), *map(pa.array, _sketch(s, of, batch.num_rows)), cells], ["key", "c", "n", *SKETCH, "cells"])

    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    return materialize(rows.mapInArrow(each, f"key long, c long, n long, {', '.join(x + ' long' for x in SKETCH)}, cells array<long>"))


def first_cells(of: DataFrame) -> DataFrame:
    """(region, c, n, s0..s3): the first cells that several classes have; materialised."""
    posted = of.select(F.explode("cells").alias("region"), "c", "n", *SKETCH)
    met = materialize(posted.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("region"))
    bits = bitmap(met, "region")
    near = posted.filter(maybe_in(bits, F.col("region")))
    out = materialize(near.join(met, "region", "left_semi").distinct())
    discard(met, bits)
    return out


def sets_of(docs: DataFrame, of: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, n, h): the shingles of the wanted classes; materialised."""

    def each(batches):
        for batch in slices(batches):
            s, row, c = shingle_sets(batch, width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s.view(np.int64)))], ["c", "h"])

    # Of each class one id is read again; rows without an id have nothing to be told by.
    ids = materialize(of.join(wanted, "c", "left_semi").groupBy("c").agg(F.min("key").alias("key")))
    key, bits = F.col("doc_id").cast("long"), bitmap(ids, "key")
    told = maybe_in(bits, key)
    some = docs.filter(told if ids.filter("key IS NULL").isEmpty() else key.isNull() | told)
    found = some.select("text").mapInArrow(each, "c long, h array<long>").join(wanted, "c", "left_semi")
    out = materialize(found.groupBy("c").agg(F.any_value("h").alias("h")).select("c", F.size("h").cast("long").alias("n"), "h"))
    discard(ids, bits)
    return out


def overlaps(pairs: DataFrame, sets: DataFrame, at_once: int = 512) -> DataFrame:
    """(a, b, na, nb, both) of pairs of classes: set sizes n, and how many of their h are common; materialised.

    A class b of many pairs is dealt to a task for every at_once of them.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / at_once).cast("int").alias("parts"))
    asked = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    held = sets.join(parts, sets.c == parts.b).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    joined = asked.join(held, ["b", "part"]).join(sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), "a")
    return materialize(joined.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("both")))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that link."""
    pairs = materialize(pairs)
    found = overlaps(pairs, sets)
    discard(pairs)
    return found.filter(linked(num, den)).select("a", "b")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """roots (node, root; None: each class is its own) after further links: only components that these bring together are looked at again."""
    if roots is None:
        return components(links)
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b")
    apart = materialize(apart.distinct())
    if apart.isEmpty():
        return roots
    more = components(apart)
    again = roots.join(more.withColumnsRenamed({"node": "old", "root": "new"}), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    discard(apart)
    return materialize(again.unionByName(more))


def linked(num: int, den: int) -> Column:
    return F.col("both") * (num + den) >= (F.col("na") + F.col("nb")) * num


def _apart() -> Column:
    """Bits that differ of two bitmaps, at most the shingles of one set only."""
    return sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))


def _fits(num: int, den: int) -> Column:
    return (
        (F.col("root_a") != F.col("root_b"))
        & (F.col("n_a") * num <= F.col("n_b") * den)
        & (F.col("n_b") * num <= F.col("n_a") * den)
        & (_apart() * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num))
    )


def star(cells: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b): each class of a cell with the cell's pivot b, if they may link."""
    pivot = F.min(F.struct(F.xxhash64("c", F.lit(turn)), *(F.col(k).alias(f"{k}_b") for k in ("c", "n", "root", *SKETCH))))
    chosen = cells.groupBy("region").agg(pivot.alias("y")).select("region", "y.*")
    members = cells.select("region", *(F.col(k).alias(f"{k}_a") for k in ("c", "n", "root", *SKETCH)))
    return members.join(chosen, "region").filter(_fits(num, den)).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()


def close(cells: DataFrame, num: int, den: int, told: int = 16) -> DataFrame:
    """(a, b): pairs of classes of a cell that may link; told: how many of its least cells a class is known by."""
    band = F.floor(F.log("n") / _band_width(num, den))  # lengths that fit are in one band or in two next to each other
    least = cells.groupBy("c").agg(F.slice(F.array_sort(F.collect_set("region")), 1, told).alias("least"))
    rows = cells.join(least, "c").withColumn("band", band)
    kept = ("c", "n", "d", "root", "least", *SKETCH)
    a = rows.select("region", F.col("band").alias("at"), F.col("band").alias("band_a"), *(F.col(k).alias(f"{k}_a") for k in kept))
    b = rows.select("region", F.explode(F.array("band", F.col("band") - 1)).alias("at"), F.col("band").alias("band_b"), *(F.col(k).alias(f"{k}_b") for k in kept))
    once = (F.col("band_a") != F.col("band_b")) | (F.col("c_a") < F.col("c_b"))
    window = F.coalesce(F.abs(F.col("d_a") - F.col("d_b")), F.lit(0.0)) <= 1 - num / den + EPS
    elsewhere = F.coalesce(F.array_min(F.array_intersect("least_a", "least_b")) < F.col("region"), F.lit(False))
    pairs = a.hint("merge").join(b, ["region", "at"]).filter(once & _fits(num, den) & window & ~elsewhere)
    return pairs.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()


def split(large: DataFrame, sets: DataFrame, turn: int, num: int, den: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """The next cells of large cells, materialised, and the links found with their pivots."""
    r = 1 - num / den
    t = min(3 * r, 1 - 2 * r)
    order = F.struct(F.xxhash64("c", F.lit(turn)), *(F.col(k).alias(f"{k}_b") for k in ("c", "n", *SKETCH)))
    chosen = large.groupBy("region", F.pmod(F.xxhash64(F.lit(turn), "c"), F.lit(pivots)).alias("bucket")).agg(F.min(order).alias("y")).select("region", "y.*")
    members = large.select("region", *(F.col(k).alias(f"{k}_a") for k in ("c", "n", *SKETCH)))
    total, most, least = F.col("n_a") + F.col("n_b"), F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    bound = F.greatest((most - least) / most, 2 * _apart() / (total + _apart()))  # the distance is this at least
    asked = materialize(members.join(chosen, "region").select("region", F.col("c_a").alias("a"), F.col("c_b").alias("b"), (bound > t + r + EPS).alias("far")))
    wanted = materialize(asked.filter("NOT far AND a <> b").select("a", "b").distinct())
    found = overlaps(wanted, sets)
    links = found.filter(linked(num, den)).select("a", "b")
    away = found.select("a", "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("away"))
    d = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.coalesce("away", F.lit(1.0)))
    seen = asked.join(away, ["a", "b"], "left").groupBy("region", "a").agg(F.collect_list(F.struct("b", d.alias("d"))).alias("seen"), F.min(d).alias("nearest"))
    window = F.least(F.col("nearest") + 2 * r, F.lit(t + r)) + EPS
    near = F.filter("seen", lambda x: x["d"] <= window)
    rest = F.when(F.col("nearest") > t, F.array(F.struct(F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("d")))).otherwise(F.array())
    placed = seen.select(F.col("region").alias("of"), F.col("a").alias("c"), F.explode(F.concat(near, rest)).alias("y"))
    carried = large.select(F.col("region").alias("of"), "c", "n", *SKETCH, F.col("size").alias("parent"))
    cell = F.xxhash64("of", F.coalesce("y.b", F.lit(0)), F.col("y.b").isNull(), F.lit(turn))
    cells = materialize(placed.join(carried, ["of", "c"]).select(cell.alias("region"), "c", "n", *SKETCH, "y.d", "parent"))
    discard(asked, wanted)
    return cells, links


def classes_linked(docs: DataFrame, of: DataFrame, width: int, num: int, den: int, leaf: int, pivots: int, stars: int) -> DataFrame | None:
    """(node, root) of the classes that link with another; None if no two classes meet."""
    first = first_cells(of)
    if first.isEmpty():
        return None
    cells = first.withColumn("d", F.lit(None).cast("double")).withColumn("parent", F.lit(None).cast("long"))
    wanted = first.select("c").distinct()
    sets, roots, turn = sets_of(docs, of, wanted, width), None, 0
    while True:
        named = cells.withColumn("root", F.col("c")) if roots is None else cells.join(roots, cells.c == roots.node, "left").select(*cells.columns, F.coalesce("root", "c").alias("root"))
        sizes = named.groupBy("region").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("region", "size")
        live = materialize(named.join(sizes, "region"))
        last = False
        if turn < stars:
            links, cells = verified(star(live, turn, num, den), sets, num, den), live.drop("root", "size")
        else:
            whole = (F.col("size") <= leaf) | F.coalesce(F.col("size") * 5 > F.col("parent") * 4, F.lit(False))
            links, large = verified(close(live.filter(whole), num, den), sets, num, den), live.filter(~whole)
            last = large.isEmpty()
            if not last:
                cells, more = split(large, sets, turn, num, den, pivots)
                links = links.unionByName(more)
        roots = joined(roots, links)
        if last:
            return roots
        turn += 1


def groups(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, leaf: int = 256, pivots: int = 4, stars: int = 1) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id (the least id reachable by links) of every document.

    leaf, pivots and stars change the work, not the result.
    """
    of = prints(docs, width, num, den)
    named = of.filter("n > 0").groupBy("c").agg(F.min("key").alias("least"))
    roots = classes_linked(docs, of, width, num, den, leaf, pivots, stars)
    named = named.withColumn("root", F.col("c")) if roots is None else named.join(roots, named.c == roots.node, "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    named = materialize(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(ids, "root").select("c", "component_id")
    some = of.filter("n > 0").select("key", "c", "n").join(of_class, "c")
    none = of.filter("n = 0").select("key", "c", "n", F.col("key").alias("component_id"))
    return some.unionByName(none).select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).alias("class_id"), "component_id")

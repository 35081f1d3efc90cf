"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is a set of words (lower case, separated by spaces, tabs or carriage returns), of `least_words` or more. A line goes if an
earlier line (by document id, then place) has a Jaccard similarity of num/den or more. Lines of the same set are one
class, of which only the first can stay, so the join is over classes:

1. Words are ordered by rarity: their counts in all lines (any order gives the same result) in 2^19 hash buckets,
   as steps of a logarithm, then by hash. Of n words at least t = ceil(n num/den) must be shared, so two similar lines share one of their n - t + 1 rarest words, the prefix. Each prefix
   word is a posting. A word of `hot` or more occurrences by these counts posts its pairs with each later word among the n - t + 2 rarest instead:
   if the first word shared is hot, so is the second, which orders after it. So no posting list is long merely because its word is common.
2. Postings meet by a left semi join under length, positional and bitmap filters (a bit is the parity of the number of words
   that fall on it, so bits that differ are at most as many as words of one set only; 64 bits, 128 for lines of more than 40 words).
   Only classes of more than one line are brought together before; the others are classes by themselves. It has a row a posting at most, however many lines are alike, and leaves the classes that may have a partner at all.
3. Among these, each class is verified with the earliest of each of its postings, which settles large groups of near
   copies by a few pairs a class; those still there are then verified with all earlier ones that pass the filters.

Counts and bitmaps of fixed size (2^19 counts, 2^23 bits) are all that tasks are sent. Classes are first told apart by
128-bit hashes of sets of words, each by 58 bits of its hash; from the search for partners on a class goes by 64 of them, so that among some 10^9 classes one pair may be taken for equal; all other similarities are verified on the words themselves.

Edge cases: null text has no lines and stays null; a null id sorts before all others; rows of equal ids are one place, so
their lines at equal places never remove each other; lines without words stay; empty tables stay empty; further columns are
carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import collected, discard, materialize

BUCKETS, BITMAP = 1 << 19, 1 << 23
SAMPLE = 1  # words are counted in one of so many lines: in all
FIRST = -(1 << 63)  # stands for a null id
WORD = (1 << 58) - 1  # bits of a word's hash; its step is above them
WIDE = 40  # lines of more words have a second half of the bitmap


def _words(line: Column) -> Column:
    """All words of a line, repeats and empty ones included."""
    spaced = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))  # translate() would look each character up in a map
    plain = F.when(line.contains("\t") | line.contains("\r"), spaced).otherwise(line)  # contains() searches faster than replace(), and most lines have neither
    return F.split(F.lower(plain), " ")


def _key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST))


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(_key(docs).alias("d"), F.posexplode_outer(F.split("text", "\n")).alias("line", "raw"))  # outer: Spark would split twice, to look for empty arrays
    return lines.filter("raw IS NOT NULL")


def place(docs: DataFrame) -> Column:
    """(d, line) as one number of the same order, which aggregates without sorting: a long if the ids span less than 2^32, else a decimal."""
    ids = docs["doc_id"].cast("long")
    low, high = collected(docs.agg(F.min(ids), F.max(ids)))[0]
    low, high = (0, 0) if low is None else (low, high)
    if low > FIRST and high - low + 1 < 1 << 32:
        return F.when(F.col("d") == FIRST, F.lit(0).cast("long")).otherwise(F.shiftleft(F.col("d") - F.lit(low - 1), 31)) + F.col("line")
    return F.col("d").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line")


def _in_order(table: DataFrame, at: str, value: str) -> DataFrame:
    return table.agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("a")).select(F.transform("a", lambda x: x[value]).alias("a"))


def _filled(words: DataFrame, size: int) -> DataFrame:
    """One row: the values v at their places w of an array of `size` longs, 0 elsewhere; materialised."""
    zeros = words.sparkSession.range(size).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    return materialize(_in_order(words.unionByName(zeros).groupBy("w").agg(F.bit_or("v").alias("v")), "w", "v"))


def rarity(docs: DataFrame) -> DataFrame:
    """One row: for each hash bucket the step, floor(2 log2) of one more than its count of words in all lines, repeats included, less 32.

    The counts only order words; any order gives the same pairs.
    """
    texts = docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("raw"))  # a text's lines need not be told apart
    if SAMPLE > 1:
        texts = _lines(docs).filter(F.xxhash64("raw").bitwiseAND(F.lit(SAMPLE - 1)) == 0).select("raw")
    words = texts.select(F.explode(_words(F.col("raw"))).alias("w")).select(F.xxhash64("w").alias("x"))
    steps = words.groupBy(F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.least(F.floor(2 * F.log2(F.count("*") + 1)), F.lit(63)).alias("s"))
    packed = _filled(steps.groupBy(F.shiftright("b", 3).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(s, 8 * (b & 7)))").alias("v")), BUCKETS // 8)
    return packed.select(F.expr("flatten(transform(a, v -> transform(sequence(0, 7), i -> cast((shiftright(v, 8 * i) & 63) - 32 as tinyint)))) AS a"))


def ranked_lines(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(d, line, r, c1, c2, n, bits, more, p): hash of the line, class of its set, number of its words, their parity bitmap and, of wide lines, the half of it
    that words with the next bit make, and the rarest n - t + 2 words in order (none if only an equal set is similar)."""
    words = F.array_remove(F.transform(_words(F.col("raw")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    hashed = _lines(docs).select("d", "line", F.xxhash64("raw").alias("r"), words.alias("h")).withColumn("steps", rarity(docs).scalar())
    rank = F.expr(f"transform(h, x -> shiftleft(cast(coalesce(steps[x & {BUCKETS - 1}L], 0Y) as bigint), 58) | (x & {WORD}))")  # steps once only: a column would be copied for each row
    ranked = hashed.select("d", "line", "r", F.sort_array(F.array_distinct(rank)).alias("h"))
    bits = F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))")
    more = F.expr(f"if(size(h) <= {WIDE}, 0L, aggregate(h, 0L, (a, x) -> if((x & 64) = 0, a, a ^ shiftleft(1L, cast(x & 63 as int)))))")
    size = F.expr(f"if(size(h) * {den - num} < {num}, 0, size(h) - (size(h) * {num} + {den - 1}) div {den} + 2)").cast("int")  # 0: only an equal set is similar
    return ranked.select("d", "line", "r", F.xxhash64("h").alias("c1"), F.xxhash64(F.lit(1), "h").alias("c2"), F.size("h").cast("long").alias("n"), bits.alias("bits"), more.alias("more"), F.slice("h", 1, size).alias("p"))


def classes(lines: DataFrame, at: Column, *columns: str) -> DataFrame:
    """The first line of each class that an unlike one can be similar to: c1, c2, its place, and the columns."""
    kept = F.min(F.struct(at.alias("at"), *columns)).alias("x")
    return lines.filter(F.size("p") > 0).groupBy("c1", "c2").agg(kept).select("c1", "c2", "x.*")


def postings(of: DataFrame, hot: int, *columns: str) -> DataFrame:
    """(columns, n, bits, more, key, left); left: how many words at most can be shared, if the key's are the first shared."""
    upto = F.lit((math.floor(2 * math.log2(max(1, (hot + 1) / SAMPLE))) - 32) << 58)
    rare = F.when(F.get("p", F.size("p") - 2) < upto, F.size("p") - 1).otherwise(F.size(F.filter("p", lambda y: y < upto)))
    pairs = "flatten(transform(sequence(rare + 1, size(p) - 1), k -> transform(slice(p, rare + 1, k - rare), x -> xxhash64(x, p[k]))))"  # by the second word
    keys = F.expr(f"if(rare < size(p) - 1, concat(slice(p, 1, rare), {pairs}), slice(p, 1, rare))")
    own = (*columns, "n", "bits", "more")
    each = of.withColumn("rare", rare).select(*own, "rare", keys.alias("keys")).select(*own, "rare", F.posexplode_outer("keys").alias("i", "y")).filter("y IS NOT NULL")
    alone = F.expr("if(i < rare, i, rare - 1 + cast(floor((sqrt(8.0D * (i - rare) + 1) + 1) / 2) as int))")  # of pairs: the second's place less one
    return each.select(*own, F.xxhash64("y").alias("key"), (F.col("n") - alone).alias("left"))


UNLIKE = f"if(a.n <= {WIDE} OR b.n <= {WIDE}, bit_count(a.bits ^ b.bits), bit_count(a.more ^ b.more) + bit_count(a.bits ^ b.bits ^ a.more ^ b.more))"


def _fits(num: int, den: int) -> str:
    """Bitmap filter, length and positional filters (similar sets share (a.n + b.n) num / (num + den) words) of the postings a and b; what is cheap and strict first."""
    return f"bit_count(a.bits ^ b.bits) * {num + den} <= (a.n + b.n) * {den - num} AND (a.n + b.n) * {num} <= least(a.left, b.left) * {num + den} AND {UNLIKE} * {num + den} <= (a.n + b.n) * {den - num}"


def bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """One row: 2^23 bits by hash of the keys."""
    bits = keys.select(F.pmod(F.xxhash64(*columns), F.lit(BITMAP)).alias("b")).distinct()
    return _filled(bits.select(F.shiftright("b", 5).alias("w"), F.expr("shiftleft(1L, cast(b % 32 as int))").alias("v")), BITMAP // 32)


def maybe_in(bits: DataFrame, *columns: Column) -> Column:
    """False only if the key is surely not among the bitmap's."""
    at = F.pmod(F.xxhash64(*columns), F.lit(BITMAP))
    return F.getbit(F.get(bits.scalar(), F.floor(at / 32).cast("int")), (at % 32).cast("int")) == 1


def _texts(docs: DataFrame, of: DataFrame) -> DataFrame:
    """(c1, words, size): the distinct words of each class as one text, which moves and sorts cheaper than an array of texts, and their number; materialised."""
    wanted = of.select("d", "line", "r", "c1")
    bits = bitmap(wanted, "d", "line")
    near = _lines(docs).filter(maybe_in(bits, F.col("d"), F.col("line"))).withColumn("r", F.xxhash64("raw"))
    one = near.join(wanted, ["d", "line", "r"]).groupBy("c1").agg(F.min("raw").alias("raw"))
    words = one.select("c1", F.array_remove(F.array_distinct(_words(F.col("raw"))), "").alias("words"))
    out = materialize(words.select("c1", F.array_join("words", " ").alias("words"), F.size("words").alias("size")))
    discard(bits)
    return out


def _verified(texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(c1) of the classes a of pairs (a, b) that are similar to b, by their very words; materialised."""
    of = lambda side: texts.select(F.col("c1").alias(side), F.col("words").alias("w" + side), F.col("size").alias("n" + side))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect(F.split("wa", " "), F.split("wb", " ")))
    similar = shared * (num + den) >= (F.col("na") + F.col("nb")) * num
    return materialize(both.filter(similar).select(F.col("a").alias("c1")).distinct())


def similar_classes(docs: DataFrame, lines: DataFrame, copies: DataFrame, at: Column, num: int, den: int, hot: int) -> DataFrame:
    """(c1) of the classes to which an earlier one is similar; materialised. copies: bitmap of the classes of more than one line."""
    fits = _fits(num, den)
    copied = maybe_in(copies, F.col("c1"), F.col("c2"))
    own = ("n", "bits", "more", "p")
    met = postings(lines.filter((F.size("p") > 0) & ~copied).select("c1", *own).unionByName(classes(lines.filter(copied), at, *own).select("c1", *own)), hot, "c1")
    some = materialize(met.alias("a").join(met.alias("b"), F.expr(f"a.key = b.key AND {fits} AND a.c1 <> b.c1"), "left_semi").select("c1").distinct())
    bits = bitmap(some, "c1")
    of = materialize(classes(lines.filter(maybe_in(bits, F.col("c1"))).join(some, "c1", "left_semi"), at, "d", "line", "r", *own))
    texts = _texts(docs, of)
    # The likeliest of the earliest of each posting, then all that fit.
    met = postings(of, hot, "c1", "at")
    first = met.groupBy("key").agg(F.min(F.struct("at", "c1", "n", "left", "bits", "more")).alias("x")).select("key", "x.*")
    star = met.alias("a").join(first.alias("b"), F.expr(f"a.key = b.key AND b.at < a.at AND {fits}")).select(F.col("a.c1").alias("a"), F.expr(UNLIKE).alias("unlike"), F.col("b.c1").alias("b"))
    one = _verified(texts, star.groupBy("a").agg(F.min(F.struct("unlike", "b")).alias("x")).select("a", "x.b"), num, den)
    left = postings(of.join(one, "c1", "left_anti"), hot, "c1", "at")
    pairs = left.alias("a").join(met.alias("b"), F.expr(f"a.key = b.key AND b.at < a.at AND {fits}")).select(F.col("a.c1").alias("a"), F.col("b.c1").alias("b")).distinct()
    two = _verified(texts, pairs, num, den)
    out = materialize(one.unionByName(two))
    discard(bits, some, of, texts, one, two)
    return out


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5, least_words: int = 1, hot: int = 1024) -> DataFrame:
    """(d, line, r) of the lines that go: the document's key, the line's place, and xxhash64 of the line; materialised."""
    if 3 * num < 2 * den:
        raise ValueError("similar lines must share two words at least: num/den of 2/3 or more")
    docs = docs.select("doc_id", "text")
    at = place(docs)
    table = materialize(ranked_lines(docs, num, den))
    lines = table.filter(F.col("n") >= max(1, least_words))
    heads = materialize(lines.groupBy("c1", "c2").agg(F.min(at).alias("first"), F.count("*").alias("many")).filter("many > 1"))
    copies = bitmap(heads, "c1", "c2")
    gone = similar_classes(docs, lines, copies, at, num, den, hot)
    # All lines of the classes that go; of the other copied ones all but the first.
    near = bitmap(gone, "c1")
    thin = lines.select("c1", "c2", "d", "line", "r").filter(maybe_in(copies, F.col("c1"), F.col("c2")) | maybe_in(near, F.col("c1")))
    found = thin.join(gone.withColumn("gone", F.lit(True)), "c1", "left").join(heads, ["c1", "c2"], "left")
    out = materialize(found.filter(F.col("gone") | (at > F.col("first"))).select("d", "line", "r").distinct())
    discard(table, heads, copies, gone, near)
    return out


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, least_words: int = 1, removed: str | None = None, hot: int = 1024) -> DataFrame:
    """All documents without the lines that go; removed: name of a further column with the places of these lines.

    Only documents that may lose a line are shuffled with their texts.
    """
    gone = removed_lines(docs, num, den, least_words, hot)
    by_doc = gone.groupBy("d").agg(F.collect_list(F.struct("line", "r")).alias("gone"))
    near = maybe_in(bitmap(gone, "d"), _key(docs))
    named = docs.select(F.struct(*docs.columns).alias("row"), _key(docs).alias("d"), near.alias("near"))
    none = F.array().cast("array<int>")
    hit = named.filter("near").join(by_doc, "d", "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    goes = F.filter("gone", lambda g: F.xxhash64(F.get("lines", g["line"])) == g["r"])  # rows of one id may differ
    hit = hit.withColumn("places", F.when(F.col("lines").isNotNull(), F.coalesce(F.array_sort(F.transform(goes, lambda g: g["line"])), none)))
    left = F.array_join(F.filter("lines", lambda raw, i: ~F.array_contains("places", i)), "\n")
    hit = hit.select("row", F.when(F.size("places") > 0, left).otherwise(F.col("row.text")).alias("kept"), "places")
    clear = named.filter("NOT near").select("row", F.col("row.text").alias("kept"), F.when(F.col("row.text").isNotNull(), none).alias("places"))
    out = [F.col("kept").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if removed:
        out.append(F.col("places").alias(removed))
    return hit.unionByName(clear).select(*out)


def dedup_sql(num: int = 4, den: int = 5, least_words: int = 1) -> str:
    """(doc_id, n_removed, removed, text_sha256) for DuckDB over a view `documents`."""
    return f"""WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
sets AS (SELECT doc_id, line, ln, list_filter(list_distinct(string_split(lower(translate(ln, chr(9) || chr(13), '  ')), ' ')), lambda x: x <> '') AS words FROM raw),
big AS (SELECT doc_id, line, list_sort(words) AS words, len(words) AS n FROM sets WHERE len(words) >= {least_words}),
classes AS MATERIALIZED (SELECT words, any_value(n) AS n, min(struct_pack(d := doc_id, l := line)) AS spot FROM big GROUP BY words),
freq AS (SELECT w, count(*) AS f FROM (SELECT unnest(words) AS w FROM classes) GROUP BY w),
ranked AS (SELECT spot, n, w, row_number() OVER (PARTITION BY spot ORDER BY f, w) AS r FROM (SELECT spot, n, unnest(words) AS w FROM classes) JOIN freq USING (w)),
prefix AS MATERIALIZED (SELECT spot, n, w FROM ranked WHERE r <= n - ((n * {num} + {den - 1}) // {den}) + 1),
cand AS (SELECT DISTINCT x.spot AS a, y.spot AS b FROM prefix x JOIN prefix y ON x.w = y.w AND y.spot < x.spot AND x.n * {den} >= y.n * {num} AND y.n * {den} >= x.n * {num}),
hit AS (SELECT DISTINCT a FROM cand JOIN classes x ON x.spot = a JOIN classes y ON y.spot = b WHERE len(list_intersect(x.words, y.words)) * {den} >= (x.n + y.n - len(list_intersect(x.words, y.words))) * {num}),
kept AS (SELECT spot.d AS doc_id, spot.l AS line FROM classes WHERE spot NOT IN (SELECT a FROM hit)),
gone AS (SELECT doc_id, line FROM big ANTI JOIN kept USING (doc_id, line)),
doc AS (SELECT doc_id, count(g.line) AS n_removed, coalesce(string_agg(CASE WHEN g.line IS NOT NULL THEN raw.line::VARCHAR END, ',' ORDER BY raw.line), '') AS removed, sha256(coalesce(string_agg(CASE WHEN g.line IS NULL THEN ln END, chr(10) ORDER BY raw.line), '')) AS text_sha256 FROM raw LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, n_removed, removed, text_sha256 FROM doc"""

"""op7's join: what it writes between, its sample of words, and the order of places."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tickvet.llm import common, linejoin

VOCAB = [a + b + c for a in "bdfgk" for b in ("a", "e", "or") for c in ("n", "st", "mi")]


def _removed(docs):
    return sorted((-1 if r.doc_id is None else r.doc_id, n) for r in linejoin.dedup_lines(docs, removed="removed").collect() for n in r.removed or [])


def _by_definition(rows):
    gone, sets = set(), lambda x: set(x.lower().split(" ")) - {""}
    everything = sorted((-1 if d is None else d, n, x) for d, t in rows for n, x in enumerate(t.split("\n")))
    for i, (d, n, x) in enumerate(everything):
        s = sets(x)
        if s and any((e, m) != (d, n) and len(s & sets(y)) * 5 >= len(s | sets(y)) * 4 for e, m, y in everything[:i]):
            gone.add((d, n))
    return sorted(gone)


def _rows(seed, ids):
    """Lines of 20 to 100 words, each with a near copy and an exact one somewhere, wide ones against narrower ones too."""
    rng, lines = random.Random(seed), []
    for n in (20, 40, 76, 84, 100):
        w = [f"{rng.choice(VOCAB)}{rng.randrange(40)}" for _ in range(n)]
        lines += [" ".join(w), " ".join(w[: n - n // 8]), " ".join(w), "  ".join(["neu", *w[2:]]), " ".join(rng.choices(VOCAB, k=n))]
    rng.shuffle(lines)
    return [(i, "\n".join(rng.sample(lines, 5))) for i in ids]


def test_no_table_of_all_words(spark, monkeypatch):
    """Words are hashed, ranked and cut in one pass: no table that is written has more of a line's words than its prefix."""
    longest = []

    def written(df):
        table = common.materialize(df)
        if {"line", "c1"} <= set(table.columns):
            longest.extend(table.agg(F.max(F.size(c) - F.expr("n - (n * 4 + 4) div 5 + 2"))).first()[0] for c, kind in table.dtypes if kind.startswith("array"))
        return table

    monkeypatch.setattr(linejoin, "materialize", written)
    rows = _rows(3, range(12))
    assert _removed(spark.createDataFrame(rows, "doc_id long, text string")) == _by_definition(rows)
    assert longest and max(longest) <= 0


def test_places(spark):
    """Ids near each other give longs, ids far apart decimals, both in the order of (d, line); classes aggregate without a sort."""
    for ids, kind in (([None, -7, 5, (1 << 32) - 10], "bigint"), ([None, -(1 << 63) + 1, -2, (1 << 63) - 1], "decimal"), ([-(1 << 63), 0], "decimal"), ([], "bigint")):
        docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
        at = linejoin.place(docs)
        spots = docs.select(linejoin._key(docs).alias("d"), F.explode(F.array(F.lit(0), F.lit(1), F.lit((1 << 31) - 1))).alias("line")).withColumn("at", at)
        assert dict(spots.dtypes)["at"].startswith(kind)
        got = [tuple(r) for r in spots.collect()]
        assert sorted(got, key=lambda r: r[2]) == sorted(got) and len({r[2] for r in got}) == len(got)
        plan = spots.groupBy("d").agg(F.min("at"))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_far_and_repeated_ids(spark):
    ids = [None, -(1 << 62), 3, 4, (1 << 62), 9]
    rows = _rows(5, ids)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert _removed(table) == sorted((-1 if d is None else d, n) for d, n in _by_definition([(-(1 << 63) if d is None else d, t) for d, t in rows]) for d in [None if d == -(1 << 63) else d])
    twice = linejoin.dedup_lines(spark.createDataFrame([(1, "a b c d\nq"), (1, "a b c d\nz"), (2, "a b c d\nq"), (3, None)], "doc_id long, text string"), removed="removed")
    assert sorted(((r.doc_id, r.text, r.removed) for r in twice.collect()), key=str) == [(1, "a b c d\nq", []), (1, "a b c d\nz", []), (2, "", [0, 1]), (3, None, None)]


def test_order_of_words_is_free(spark, monkeypatch):
    """The sample that words are counted in orders them only: none of the lines, or all, give the same result."""
    rows = _rows(11, range(14))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (1, 16, 1 << 20):
        monkeypatch.setattr(linejoin, "SAMPLE", sample)
        assert _removed(table) == _by_definition(rows)


def test_shingles_are_counted_in_all_documents(spark):
    from tickvet.llm import docjoin

    docs = spark.createDataFrame([(d, f"one two three four five a{d} b{d} c{d} d{d} e{d}") for d in range(300)], "doc_id long, text string")
    levels = docjoin.common_shingles(docs, 5)
    batch = pa.RecordBatch.from_pydict({"text": ["one two three four five"]})
    shingle = docjoin.shingle_sets(batch, 5)[0][0]
    assert levels[int(shingle) & (len(levels) - 1)] == 32  # floor(4 log2 300)


def test_words_are_counted_in_all_lines(spark):
    docs = spark.createDataFrame([(d, f"Same{chr(9)}own{d}\nsame b{d}") for d in range(100)], "doc_id long, text string")
    steps = linejoin.rarity(docs).first().a
    b = docs.select(F.xxhash64(F.lit("same")).bitwiseAND(F.lit(linejoin.BUCKETS - 1)).alias("b")).first().b
    assert steps[b] == 15 - 32  # floor(2 log2 201)


def test_no_text_is_translated_by_character(spark, monkeypatch):
    """Lines and words are told apart by searching bytes: no step's plan has translate(), which looks each character of all texts up in a map."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return common.materialize(df)

    monkeypatch.setattr(linejoin, "materialize", written)
    rows = [(1, "a\tb c\rd e\nx"), (2, "a b\tc d E\r"), (3, "a\r\tb c\nE d c b a")]
    assert _removed(spark.createDataFrame(rows, "doc_id long, text string")) == [(2, 0), (3, 1)]
    assert any("xxhash64" in p for p in plans) and not any("translate(" in p for p in plans)


def test_words_are_written_as_one_text(spark, monkeypatch):
    """The words that pairs are verified on are written, shuffled and sorted as one text a class, not as an array of texts; tabs, carriage returns and empty words are told as ever."""
    kinds = []

    def written(df):
        kinds.extend(df.dtypes)
        return common.materialize(df)

    monkeypatch.setattr(linejoin, "materialize", written)
    rows = [(1, "\tOne  two\tthree four five\r\nsix seven eight nine ten"), (2, "five four\rthree two one ONE extra\nTEN\tnine eight seven six\t"), (3, "one two three four other words")]
    assert _removed(spark.createDataFrame(rows, "doc_id long, text string")) == [(2, 0), (2, 1)]
    assert ("words", "string") in kinds and not any(kind == "array<string>" for _, kind in kinds)

"""Rules of neighbours over a stream: what a replayed stream finds, in any order of arrival, is what the batch finds."""

import random

import pytest

from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.rules import CHECKS
from tickvet.operators.tables import BARS, DATASETS, DIVIDENDS, SPLITS, MarketTables
from tickvet.streaming.neighbours import NEIGHBOUR, neighbour_occurrences, settled, with_neighbours

DAY = 86_400_000


def series(rng, name, n):
    out, t, close = [], 1704153600000, 100.0
    for i in range(n):
        t += DAY * rng.choice([1, 1, 1, 1, 12, -2])
        close = rng.choice([close, close, close * 1.01, close / 2, close * 2, None, float("nan"), 100.0] if close == close and close else [100.0])
        out.append((name, i, f"day {t // DAY}", rng.choice([t, t, t, t, None]), 1.0, 1.0, 1.0, close, rng.choice([None, 0.0, 5.0, 10.0]), None))
        close = close or 100.0
    return out


def run(spark, tmp_path, batches, make):
    path = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(f"file://{path}/b={i}")
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/b=*")
    name = f"t{random.getrandbits(40)}"
    make(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start().awaitTermination(200)
    return spark.table(name)


def found(df):
    return sorted((r.dataset_id, r.rule, r.k1, r.k2, r.severity, str(r.where_date), str(r.value), r.evidence) for r in df.collect())


@pytest.mark.parametrize("shuffled", [False, True])
def test_replay_equals_batch(spark, tmp_path, shuffled):
    rng = random.Random(4)
    rows = series(rng, "a", 60) + series(rng, "b", 25) + series(rng, "c", 1)
    t0 = [r[3] for r in rows if r[0] == "a" and r[3]]
    splits = spark.createDataFrame([("a", 0, "x", t0[20], 2.0, 1.0), ("b", 0, None, None, 2.0, 1.0), ("z", 0, "x", t0[1], 2.0, 1.0)], SPLITS)
    order = rng.sample(rows, len(rows)) if shuffled else rows
    got = settled(run(spark, tmp_path, [order[i::5] if shuffled else order[i * 18 : i * 18 + 18] for i in range(5)], lambda s: neighbour_occurrences(s, splits)))
    t = MarketTables(spark.createDataFrame([], DATASETS), spark.createDataFrame(rows, BARS), spark.createDataFrame([], DIVIDENDS), splits)
    want = sorted(x for r in NEIGHBOUR for x in found(CHECKS[r](t, CHECK_RULES[r].params)))
    assert {w[1] for w in want} == set(NEIGHBOUR)
    assert found(got) == want


def test_late_and_given_up(spark, tmp_path):
    bar = lambda seq, close: ("d", seq, f"s{seq}", None, 1.0, 1.0, 1.0, close, 1.0, None)
    batches = [[bar(0, 1.0), bar(2, 3.0)], [bar(3, 3.0), bar(0, 9.0)], [bar(4, 3.0), bar(None, 1.0)], [bar(1, 2.0), bar(5, 3.0)]]
    rows = run(spark, tmp_path, batches, lambda s: with_neighbours(s, most_held=2)).collect()
    got = sorted((r.seq if r.seq is not None else -1, r.late, r.p_seq, r.run_n) for r in rows)
    assert got == [(-1, True, None, None), (0, False, None, 1), (0, True, None, None), (1, True, None, None), (2, False, 0, 1), (3, False, 2, 2), (4, False, 3, 3), (5, False, 4, 4)]


def test_buckets_hold_many_datasets(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for i in range(30) for r in series(rng, f"d{i}", 7)] + series(rng, None, 5)
    order = rng.sample(rows, len(rows))
    batches = [order[i::3] for i in range(3)]

    def kept(name, **buckets):
        (path := tmp_path / name).mkdir()
        got = run(spark, path, batches, lambda s: with_neighbours(s, **buckets).select("dataset_id", "seq", "close", "p_close", "p_seq", "run_n", "run_seq", "late"))
        return sorted(map(str, got.collect()))

    assert kept("few", buckets=2) == kept("many")
    state = spark.read.format("statestore").load(f"file://{tmp_path}/few/state")
    assert state.count() <= 2  # not one for each of 31 datasets
    late = [r for r in kept("again", buckets=2) if "late=True" in r]
    assert late == []

"""Even thinning against its definition, and the grouping of all findings."""

import pytest

from tickvet.operators import engine
from tickvet.operators.report_data import thinned


@pytest.mark.parametrize("most", [2, 3, 7, 12])
def test_thinned(spark, most):
    sizes = {"one": 1, "two": 2, "seven": 7, "eight": 8, "hundred": 100, "odd": 997}
    value = lambda i: None if i % 9 == 4 else float("nan") if i % 9 == 5 else float(i * 37 % 101)
    rows = [(k, i, value(i)) for k, n in sizes.items() for i in range(n)]
    got = thinned(spark.createDataFrame(rows, "dataset_id string, seq int, close double"), ["seq"], ["close"], most).orderBy("point").collect()
    for k, n in sizes.items():
        mine = [r for r in got if r.dataset_id == k]
        assert [r.seq for r in mine] == (list(range(n)) if n <= most else [(2 * i * (n - 1) + most - 1) // (2 * (most - 1)) for i in range(most)])
        assert [r.point for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {n}
        good = [v for v in map(value, range(n)) if v is not None and v == v]
        assert {(r.low, r.high) for r in mine} == {(min(good), max(good))}


def test_thinned_edges(spark):
    empty = spark.createDataFrame([], "dataset_id string, seq int, close double")
    assert thinned(empty, ["seq"], ["close"]).count() == 0
    bad = spark.createDataFrame([("a", i, None) for i in range(5)], "dataset_id string, seq int, close double")
    assert [(r.seq, r.low) for r in thinned(bad, ["seq"], ["close"], 2).orderBy("seq").collect()] == [(0, None), (4, None)]
    with pytest.raises(ValueError):
        thinned(empty, ["seq"], ["close"], 1)


def test_rollup(spark):
    reports = spark.createDataFrame([("a", "x", 60, 1, 0, 0), ("b", "x", 100, 0, 0, 0), ("c", "y", 80, 0, 1, 1), ("d", None, 100, 0, 0, 0)], "dataset_id string, source string, sanity_score int, critical long, warning long, info long")
    found = spark.createDataFrame([("a", "R1", "critical", "d1", 3), ("c", "R1", "warning", "d1", 1), ("c", "R2", "info", "d2", 2)], "dataset_id string, rule string, severity string, dimension string, occurrences long")
    rows = engine.rollup(reports, found).collect()
    got = {(r.level, r.source, r.dimension, r.rule): (r.datasets, r.findings, r.critical, r.warning, r.info, r.occurrences, r.audited, r.clean, r.mean_score) for r in rows}
    assert len(rows) == len(got) and got == {
        (0, "x", "d1", "R1"): (1, 1, 1, 0, 0, 3, None, None, None), (0, "y", "d1", "R1"): (1, 1, 0, 1, 0, 1, None, None, None), (0, "y", "d2", "R2"): (1, 1, 0, 0, 1, 2, None, None, None),
        (1, "x", "d1", None): (1, 1, 1, 0, 0, 3, None, None, None), (1, "y", "d1", None): (1, 1, 0, 1, 0, 1, None, None, None), (1, "y", "d2", None): (1, 1, 0, 0, 1, 2, None, None, None),
        (3, "x", None, None): (1, 1, 1, 0, 0, 3, 2, 1, 80.0), (3, "y", None, None): (1, 2, 0, 1, 1, 3, 1, 0, 80.0), (3, None, None, None): (0, 0, 0, 0, 0, 0, 1, 1, 100.0),
        (7, None, None, None): (2, 3, 1, 1, 1, 6, 4, 2, 85.0),
    }
    assert engine.rollup(reports.limit(0), found.limit(0)).filter("level < 7").count() == 0

"""Structural validation by path, and joins by buckets, against literals and brute force."""

import json
import random

import pytest

from tickvet.operators import engine
from tickvet.operators.bands import band_join
from tickvet.operators.rules import CHECKS, RowRule
from tickvet.operators.tables import BARS, DATASETS, DIVIDENDS, SPLITS, MarketTables
from tickvet.sources import structure

BAR = {"timestamp": "2024-01-02", "open": 185.64, "high": 186.05, "low": 183.89, "close": 185.14, "volume": 82488700}
VALID = {"symbol": "AAPL", "source": "yahoo", "currency": "USD", "bars": [BAR]}


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


CASES = {
    "valid": (VALID, []),
    "no symbol": (without(VALID, "symbol"), [("symbol", "missing")]),
    "no source": (without(VALID, "source"), [("source", "missing")]),
    "pence": (VALID | {"currency": "GBX"}, []),
    "small letters": (VALID | {"currency": "usd"}, [("currency", "format")]),
    "implausible": (VALID | {"bars": [{"timestamp": "2024-01-02", "open": -5, "high": 1, "low": 10, "close": 185.14}]}, []),
    "types": (VALID | {"symbol": 7, "exchange": None}, [("symbol", "type"), ("exchange", "type")]),
    "empty": (VALID | {"symbol": "", "bars": []}, [("symbol", "empty")]),
    "bars": (VALID | {"bars": [BAR | {"close": "185"}, "garbage", None, without(BAR, "open") | {"volume": None}, BAR | {"timestamp": "soon", "adjustmentFactor": 0}, BAR | {"timestamp": 20240102}]}, [("bars.0.close", "type"), ("bars.1", "type"), ("bars.2", "type"), ("bars.3.open", "missing"), ("bars.3.volume", "type"), ("bars.4.timestamp", "format"), ("bars.4.adjustmentFactor", "range")]),
    "actions": (VALID | {"dividends": [{"exDate": "2024-05-10", "amount": 3.5, "type": "extra"}, {"amount": True, "currency": "E"}], "splits": [{"exDate": "2024-06-03", "numerator": -2, "denominator": 1}]}, [("dividends.0.type", "enum"), ("dividends.1.exDate", "missing"), ("dividends.1.amount", "type"), ("dividends.1.currency", "format"), ("splits.0.numerator", "range")]),
    "shapes": (without(VALID, "bars") | {"dividends": {}, "identifiers": [], "fundamentals": {"eps": "1"}}, [("identifiers", "type"), ("bars", "missing"), ("dividends", "type"), ("fundamentals.eps", "type")]),
}


def test_issues_by_path(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in CASES.items()] + [("broken", "{not json"), ("null", None), ("number", "5"), ("bare", json.dumps([BAR, {"open": 1}]))]
    got = {}
    for r in structure.issues(spark.createDataFrame(rows, "dataset_id string, text string")).orderBy("dataset_id", "place").collect():
        got.setdefault(r.dataset_id, []).append((r.path, r.code))
    want = {k: v for k, (_, v) in CASES.items() if v} | {"broken": [("(root)", "json")], "null": [("(root)", "json")], "number": [("(root)", "type")]}
    want["bare"] = [("symbol", "missing"), ("source", "missing"), ("bars.1.timestamp", "missing"), *((f"bars.1.{x}", "missing") for x in ("high", "low", "close"))]
    assert got == want
    named = structure.issues(spark.createDataFrame([("bare", json.dumps([BAR]))], "dataset_id string, text string"), "S", "json")
    assert named.count() == 0
    assert structure.issues(spark.createDataFrame([], "dataset_id string, text string")).count() == 0


def test_findings_are_bounded(spark):
    text = json.dumps(VALID | {"bars": [{"timestamp": "2024-01-02"}] * 8})
    got = structure.findings(structure.issues(spark.createDataFrame([("a", text)], "dataset_id string, text string"))).orderBy("rule_rank").collect()
    assert len(got) == 20 and got[0].occurrences == 32 and {r.occurrences for r in got[1:]} == {1}
    assert got[0].explanation == 'structure not valid at "bars.0.open": expected number, received missing'


@pytest.mark.parametrize(("low", "high"), [(-3, 3), (1, 5), (0, 0), (-10, -1)])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_band_join(spark, low, high, how):
    rng = random.Random(low * 7 + high)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(-20, 20)])) for i in range(60)]
    right = [(i, rng.choice("abc"), rng.choice([None, *range(-20, 20)])) for i in range(60)]
    a = spark.createDataFrame(left, "i int, k string, x long")
    b = spark.createDataFrame(right, "j int, kk string, y long")
    got = sorted((r.i, None if how == "left_anti" else r.j) for r in band_join(a, b, {"k": "kk"}, "x", "y", low, high, how=how).collect())
    want = []
    for i, k, x in left:
        met = [j for j, kk, y in right if k == kk and x is not None and y is not None and low <= y - x <= high]
        want += [(i, None)] * (not met) if how == "left_anti" else [(i, j) for j in met] + [(i, None)] * (how == "left" and not met)
    assert got == sorted(want, key=lambda p: (p[0], p[1] is not None, p[1])) or sorted(map(str, got)) == sorted(map(str, want))


def test_rule_that_fails_is_named(spark, monkeypatch):
    bar = ("d", 0, "2024-01-02", 1704153600000, 1.0, 1.0, 1.0, 1.0, None, None)
    t = MarketTables(spark.createDataFrame([("d", "S", "x", *[None] * 9)], DATASETS), spark.createDataFrame([bar], BARS), spark.createDataFrame([], DIVIDENDS), spark.createDataFrame([], SPLITS))
    from pyspark.sql import functions as F

    monkeypatch.setitem(CHECKS, "VOLUME_NEGATIVE", RowRule("bars", lambda p: [F.raise_error(F.lit("no")).cast("struct<rule:string,k1:bigint,k2:bigint,severity:string,where_date:string,value:double,evidence:string>")]))
    with pytest.raises(engine.RuleFailed, match="VOLUME_NEGATIVE") as e:
        engine.check(t)
    assert e.value.rule == "VOLUME_NEGATIVE"
    monkeypatch.setitem(CHECKS, "VOLUME_NEGATIVE", RowRule("bars", lambda p: p["no such"]))
    with pytest.raises(engine.RuleFailed, match="VOLUME_NEGATIVE"):
        engine.check(t)

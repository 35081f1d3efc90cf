"""Texts of findings: values, parameters, missing values, and that every rule's text names evidence that its findings have."""

import json

from pyspark.sql import functions as F
from test_market import tables
from test_reports import CASES

from tickvet.operators import engine
from tickvet.operators.catalog import CHECK_RULES, COMPARE_RULES
from tickvet.operators.explain import TEXTS, evidence_text, sentences, told


def text(spark, rule, evidence, params=None):
    df = spark.createDataFrame([(rule, evidence)], "rule string, evidence string")
    return df.select(told(F.col("rule"), F.col("evidence"), CHECK_RULES, {rule: params or {}}).alias("t")).first().t


def test_every_rule_has_a_text():
    assert set(TEXTS) == {*CHECK_RULES, *COMPARE_RULES}
    assert all(sentences(r, {}) for r in [*CHECK_RULES.values(), *COMPARE_RULES.values()])


def test_values_and_parameters(spark):
    got = text(spark, "RETURN_SPIKE", '{"return":-0.1234,"modified_zscore":7.125}', {"zscoreThreshold": 4.0})
    assert got == "a return of -12.34 % has the modified z-score 7.13, the bound is 4"
    assert text(spark, "VOLUME_NEGATIVE", '{"volume":"-1.0E7"}') == "volume is -10000000"
    assert text(spark, "PRICE_NONPOSITIVE", '{"field":"open","value":"NaN"}') == "open is NaN"
    assert text(spark, "SYMBOL_MAPPING_SUSPECT", '{"isin":"0700","exchange":"{isin}","exchange_country":"HK"}') == "ISIN 0700; listed on {isin} of HK"  # as they stand


def test_a_sentence_without_its_values_is_left_out(spark):
    assert text(spark, "DIV_SCALE_100X", '{"amount":2.0,"prev_close":4.0,"single_yield_pct":0.5}') == "2 is 50.00 % of the previous close 4, the bound is 0.25"
    assert text(spark, "CURRENCY_SUSPECT", "{}") == ""
    assert text(spark, "CURRENCY_SUSPECT", None) == ""
    assert text(spark, "SCHEMA_INVALID", '{"path":"bars"}') == ""  # no rule of the catalog


def test_evidence_text(spark):
    df = spark.createDataFrame([('{"b":1.50000049,"a":"x"}',), ("{}",), (None,)], "evidence string")
    assert [r.t for r in df.select(evidence_text(F.col("evidence")).alias("t")).collect()] == ["a=x, b=1.5", "", None]


def test_explanations_of_whole_reports(spark):
    _, findings = engine.check(tables(spark, **{k: d for k, (d, _, _) in CASES.items()}))
    got = {(r.dataset_id, r.rule): r for r in findings.collect()}
    assert got["bars only", "INSUFFICIENT_DATA"].explanation == "INSUFFICIENT_DATA: too few bars to judge: 2 bars where 10 are needed"
    late = got["late drop", "EXDATE_MISPLACED"]
    assert "one that fits is seen on 2023-06-15" in late.explanation and late.explanation.endswith(", at 2023-06-06")
    assert json.loads(late.evidence)["matched_date"] == "2023-06-15"
    assert all("{" not in r.explanation and "null" not in r.explanation for r in got.values())
    assert findings.filter("false").collect() == []

"""Registered queries over the derived market data: every rule, both engines, and the shared operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.functions import weekdays_between
from tickvet.functions.numbers import scaled
from tickvet.operators import compare as cmp
from tickvet.operators import engine, report_data
from tickvet.operators.catalog import CHECK_RULES, COMPARE_RULES
from tickvet.operators.explain import evidence_text
from tickvet.operators.rules import CHECKS
from tickvet.plans import csvs, oracles, streams, texts
from tickvet.plans.derived import pair_tables, tables

CONFIG = engine.Config({k: engine.Override(params=v) for k, v in oracles.PARAMS.items()}, {k: engine.Override(params=v) for k, v in oracles.COMPARE_PARAMS.items()})


def _occurrences(df: DataFrame) -> DataFrame:
    return df.select("dataset_id", "k1", "k2", "severity", "where_date", scaled("value", 6).alias("value"))


def _check_rule(rule):
    return lambda spark, sf_dir: _occurrences(CHECKS[rule](tables(spark, sf_dir), {**CHECK_RULES[rule].params, **oracles.PARAMS.get(rule, {})}))


def _compare_rule(rule):
    return lambda spark, sf_dir: _occurrences(cmp.COMPARES[rule](pair_tables(spark, sf_dir), {**COMPARE_RULES[rule].params, **oracles.COMPARE_PARAMS.get(rule, {})}))


def _checked(spark, sf_dir):
    return engine.check(tables(spark, sf_dir), CONFIG)


def reports(spark, sf_dir):
    return _checked(spark, sf_dir)[0]


def findings(spark, sf_dir):
    got = _checked(spark, sf_dir)[1]
    return got.select("dataset_id", "rule", "severity", F.coalesce("where_date", F.lit("")).alias("where_date"), "occurrences", "action", "dimension", "explanation", evidence_text(F.col("evidence")).alias("evidence"))


def scoreboard(spark, sf_dir):
    return engine.scoreboard(reports(spark, sf_dir)).withColumn("worst", F.array_join("worst", ","))


def frequency(spark, sf_dir):
    return engine.rule_frequency(_checked(spark, sf_dir)[1])


def compare_reports(spark, sf_dir):
    return cmp.compare(pair_tables(spark, sf_dir), CONFIG)[0].drop("symbol", "source_a", "source_b")


def profile(spark, sf_dir):
    e = tables(spark, sf_dir).enriched
    return e.groupBy("dataset_id").agg(F.count("ret").alias("returns"), scaled(F.first("ret_median"), 9).alias("median_return"), scaled(F.first("ret_mad"), 9).alias("mad_return"))


def as_of_dividends(spark, sf_dir):
    return tables(spark, sf_dir, "u").paid.select("dataset_id", "seq", "idx", scaled("ex_close", 6).alias("ex_close"), scaled("prev_close", 6).alias("prev_close"))


def aligned(spark, sf_dir):
    return pair_tables(spark, sf_dir).aligned.select("dataset_id", "day", scaled("a_close", 6).alias("a_close"), scaled("b_close", 6).alias("b_close"))


def weekday_gaps(spark, sf_dir):
    return tables(spark, sf_dir).enriched.filter("p_t IS NOT NULL").select("dataset_id", "seq", weekdays_between(F.col("p_t"), F.col("t")).alias("gap"))


def rollup(spark, sf_dir):
    return engine.rollup(*_checked(spark, sf_dir))


def marks(spark, sf_dir):
    return report_data.marks_by_date(_checked(spark, sf_dir)[1])


def gated(spark, sf_dir):
    got = engine.gate(reports(spark, sf_dir), "warning", 60)
    return got.select("dataset_id", "exit_code", F.array_join("reasons", "; ").alias("reasons"))


def next_bars(spark, sf_dir):
    """Of each dividend the first bar on or after its ex-date."""
    t = tables(spark, sf_dir, "u")
    got = report_data.first_bar_on_or_after(t.dividends, t.enriched.select("dataset_id", "t", "rn", "ts_raw", "close"))
    return got.select("dataset_id", "seq", F.col("bar.rn").cast("long").alias("rn"), F.col("bar.ts_raw").alias("bar_day"), scaled("bar.close", 6).alias("close"))


def divergences(spark, sf_dir):
    return report_data.divergences(pair_tables(spark, sf_dir).aligned).select("dataset_id", "day", scaled("gap", 6).alias("gap"))


def thinned_closes(spark, sf_dir):
    got = report_data.thinned(tables(spark, sf_dir).bars, ["seq"], ["close"], 12)
    return got.select("dataset_id", "point", "seq", scaled("close", 6).alias("close"), "n", scaled("low", 6).alias("low"), scaled("high", 6).alias("high"))


QUERIES = {
    "check_reports": reports, "check_findings": findings, "check_scoreboard": scoreboard, "check_rule_frequency": frequency, "compare_reports": compare_reports,
    "returns_profile": profile, "as_of_dividends": as_of_dividends, "aligned_days": aligned, "weekday_gaps": weekday_gaps, "schema_issues": texts.schema_issues, "schema_findings": texts.schema_findings, "csv_bars": csvs.csv_bars, "csv_files": csvs.csv_files, "stream_findings": streams.stream_findings,
    "check_rollup": rollup, "check_marks": marks, "check_gate": gated, "next_bars": next_bars, "close_divergences": divergences, "thinned_closes": thinned_closes,
    **{f"r_{r.lower()}": _check_rule(r) for r in CHECKS}, **{f"r_{r.lower()}": _compare_rule(r) for r in cmp.COMPARES},
}
SQL = {
    "check_reports": oracles.REPORTS_SQL, "check_findings": oracles.FINDINGS_SQL, "check_scoreboard": oracles.SCOREBOARD_SQL, "check_rule_frequency": oracles.FREQUENCY_SQL, "compare_reports": oracles.COMPARE_REPORTS_SQL,
    "returns_profile": oracles.PROFILE_SQL, "as_of_dividends": oracles.AS_OF_SQL, "aligned_days": oracles.ALIGNED_SQL, "weekday_gaps": oracles.WEEKDAYS_SQL, "schema_issues": texts.ISSUES_SQL, "schema_findings": texts.FINDINGS_SQL, "csv_bars": csvs.BARS_SQL, "csv_files": csvs.FILES_SQL, "stream_findings": streams.STREAM_SQL,
    "check_rollup": oracles.ROLLUP_SQL, "check_marks": oracles.MARKS_SQL, "check_gate": oracles.GATE_SQL, "next_bars": oracles.NEXT_BAR_SQL, "close_divergences": oracles.DIVERGENCES_SQL, "thinned_closes": oracles.THINNED_SQL,
    **{f"r_{r.lower()}": oracles.rule_sql(r) for r in [*CHECKS, *cmp.COMPARES]},
}

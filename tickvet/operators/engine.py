"""Plan the enabled rules, collapse occurrences to findings, score datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvet.operators.catalog import ACTIONS, CHECK_RULES, COMPARE_RULES, PENALTIES, REFERENCES, SEVERITIES, Rule, order_of
from tickvet.operators.explain import told
from tickvet.operators.rules import CHECKS, RowRule, row_occurrences
from tickvet.operators.tables import MarketTables
from tickvet.shared import NARROW, written

OCCURRENCES = "dataset_id string, rule string, k1 long, k2 long, severity string, where_date string, value double, evidence string"


@dataclass(frozen=True)
class Override:
    enabled: bool = True
    severity: str | None = None
    params: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    rules: Mapping[str, Override] = field(default_factory=dict)
    compare_rules: Mapping[str, Override] = field(default_factory=dict)


def _lookup(key: Column, values: Mapping[str, object]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


class RuleFailed(Exception):
    """A rule that could not be planned or computed, by name."""

    def __init__(self, rule: str, why: Exception):
        super().__init__(f"rule {rule} failed: {why}")
        self.rule = rule


def _enabled(rules: Mapping[str, Rule], checks: Mapping[str, Callable], overrides: Mapping[str, Override]) -> dict[str, tuple[Callable, dict]]:
    chosen = ((id_, check, overrides.get(id_, Override())) for id_, check in checks.items())
    return {id_: (check, {**rules[id_].params, **o.params}) for id_, check, o in chosen if o.enabled}


def planned(rules: Mapping[str, Rule], checks: Mapping[str, Callable], overrides: Mapping[str, Override], tables) -> DataFrame | None:
    """All enabled rules' occurrences; disabled rules are not planned at all. None if no rule is enabled.

    Rules that look at rows of one table share a scan of it; only the others are branches of their own.
    """
    by_source, parts = {}, []
    for id_, (check, params) in _enabled(rules, checks, overrides).items():
        if isinstance(check, RowRule):
            try:
                check.hits(params), check.columns(params)
            except Exception as e:
                raise RuleFailed(id_, e) from e
            by_source.setdefault("enriched" if check.source == "bars" else check.source, []).append((check, params))
        else:
            try:
                parts.append(check(tables, params))
            except Exception as e:
                raise RuleFailed(id_, e) from e
    parts += [row_occurrences(tables, source, together) for source, together in by_source.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None


def computed(rules: Mapping[str, Rule], checks: Mapping[str, Callable], overrides: Mapping[str, Override], tables) -> DataFrame | None:
    """Findings of all enabled rules, written; None if no rule is enabled. If it fails, the first rule that fails alone is named."""
    try:
        found = planned(rules, checks, overrides, tables)
        return written(collapse(found, rules, overrides), NARROW) if found is not None else None
    except RuleFailed:
        raise
    except Exception as e:
        for id_, (check, params) in _enabled(rules, checks, overrides).items():
            try:
                check(tables, params).write.format("noop").mode("overwrite").save()
            except Exception as why:
                raise RuleFailed(id_, why) from e
        raise


def collapse(found: DataFrame, rules: Mapping[str, Rule], overrides: Mapping[str, Override]) -> DataFrame:
    """One finding for each dataset and rule: its first occurrence, and how many there are."""
    first = F.min_by(F.struct("severity", "where_date", "value", "evidence"), F.struct("k1", "k2"))
    out = found.groupBy("dataset_id", "rule").agg(first.alias("f"), F.count("*").alias("occurrences"))
    forced = {k: o.severity for k, o in overrides.items() if o.severity and k in rules}
    severity = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in forced.items() for x in kv)), "rule"), "f.severity") if forced else F.col("f.severity")
    links = F.create_map(*(x for k, v in REFERENCES.items() if k in rules for x in (F.lit(k), F.array(*map(F.lit, v)))))
    out = out.select("dataset_id", "rule", severity.alias("severity"), "f.where_date", "f.value", "f.evidence", "occurrences")
    text = told(F.col("rule"), F.col("evidence"), rules, {k: o.params for k, o in overrides.items() if k in rules})
    return out.withColumns({
        "action": _lookup(F.col("severity"), ACTIONS), "dimension": _lookup(F.col("rule"), {r.id: r.dimension for r in rules.values()}),
        "explanation": F.concat(F.concat_ws(": ", F.col("rule"), _lookup(F.col("rule"), {r.id: r.description for r in rules.values()}), F.nullif(text, F.lit(""))), F.when(F.col("where_date").isNotNull(), F.concat(F.lit(", at "), "where_date")).otherwise(""), F.when(F.col("occurrences") > 1, F.concat(F.lit(" (first of "), F.col("occurrences").cast("string"), F.lit(")"))).otherwise("")),
        "severity_rank": _lookup(F.col("severity"), {s: i for i, s in enumerate(SEVERITIES)}), "rule_rank": _lookup(F.col("rule"), order_of(dict(rules))),
        "references": F.coalesce(F.try_element_at(links, "rule"), F.array().cast("array<string>")),
    })


def scores(datasets: DataFrame, findings: DataFrame, score: str) -> DataFrame:
    """datasets with score 0 to 100 and the number of rules by severity; datasets without findings score 100."""
    penalty = F.sum(_lookup(F.col("severity"), PENALTIES))
    counts = findings.groupBy("dataset_id").agg(penalty.alias("penalty"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    out = datasets.join(counts.hint("merge"), "dataset_id", "left")  # counts grow with the datasets; a broadcast would pass them through the driver
    zero = {s: F.coalesce(F.col(s), F.lit(0)) for s in SEVERITIES}
    return out.withColumns({score: F.greatest(F.lit(0), 100 - F.coalesce("penalty", F.lit(0))).cast("int"), **zero}).drop("penalty")


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "reliable").when(score >= 70, "usable with caution").when(score >= 40, "suspicious").otherwise("not fit for production")


def check(tables: MarketTables, config: Config = Config(), invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of all datasets. invalid: structural findings; their datasets take no part in the rules.

    All rules run here, in one job over tables written once; the findings are written, so both results are cheap to read.
    """
    tables = tables.written(bars=False)  # rules see bars only through enriched, which is written
    if invalid is not None:
        bad = invalid.select("dataset_id").distinct()
        keep = lambda df: df.join(bad, "dataset_id", "left_anti")
        valid = MarketTables(keep(tables.datasets), keep(tables.bars), keep(tables.dividends), keep(tables.splits)).written(bars=False)
    else:
        valid = tables
    findings = computed(CHECK_RULES, CHECKS, config.rules, valid)
    if findings is None:
        findings = collapse(tables.datasets.sparkSession.createDataFrame([], OCCURRENCES), CHECK_RULES, config.rules)
    if invalid is not None:
        findings = findings.unionByName(invalid, allowMissingColumns=True)
    reports = scores(tables.datasets.select("dataset_id", "symbol", "source"), findings, "sanity_score")
    return reports, findings


def ordered_findings(findings: DataFrame) -> DataFrame:
    """dataset_id and its findings as one array by severity, then rule."""
    fields = ["severity_rank", "rule_rank", "rule", "severity", "action", "dimension", "where_date", "explanation", "evidence", "occurrences", "references"]
    return findings.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))


def history_entries(reports: DataFrame, findings: DataFrame, at: str) -> DataFrame:
    """What the history store keeps of each report."""
    rules = findings.groupBy("dataset_id").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    out = reports.join(rules, "dataset_id", "left")
    return out.select(F.lit(at).alias("at"), "symbol", "source", "sanity_score", F.struct(*SEVERITIES).alias("summary"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def gate(reports: DataFrame, fail_on: str = "critical", min_score: int | None = None, score: str = "sanity_score") -> DataFrame:
    """reports with exit_code 1 and reasons where a severity at or above fail_on occurs or the score is below min_score."""
    worse = SEVERITIES[: SEVERITIES.index(fail_on) + 1]
    reasons = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in worse]
    if min_score is not None:
        reasons.append(F.when(F.col(score) < min_score, F.lit(f"score below {min_score}")))
    out = reports.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return out.withColumn("exit_code", F.when(F.size("reasons") > 0, 1).otherwise(0))


def scoreboard(reports: DataFrame) -> DataFrame:
    """Of each source: datasets, mean (1 digit) and least score, totals by severity, clean ones, and the five worst symbols."""
    worst = F.slice(F.array_sort(F.collect_list(F.struct("sanity_score", "symbol"))), 1, 5)
    # Only each source's five worst come together, not all its reports.
    from pyspark.sql import Window

    ranked = reports.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("sanity_score", "symbol"))).filter("r <= 5").groupBy("source").agg(F.transform(worst, lambda x: x["symbol"]).alias("worst"))
    base = reports.groupBy("source").agg(F.count("*").alias("datasets"), F.round(F.avg("sanity_score"), 1).alias("mean_score"), F.min("sanity_score").alias("min_score"), *(F.sum(s).alias(s) for s in SEVERITIES), F.count_if(F.col("sanity_score") == 100).alias("clean"))
    return base.join(ranked, "source")


def rule_frequency(findings: DataFrame) -> DataFrame:
    """How often each rule and severity was found, most frequent first."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("datasets"), F.sum("occurrences").alias("occurrences"))


def rollup(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """One grouping of all findings by source, dimension and rule, with subtotals; level tells which of them a row sums over.

    level: 0 a rule, 1 a dimension (rule is null), 3 a source, 7 all. datasets: those with findings. audited, clean and
    mean_score are of all datasets and stand on levels 3 and 7, null below: reports are rows of the same grouping, without
    dimension and rule. Datasets of a null source are a source by themselves.
    """
    zero = lambda name, type_: F.lit(None).cast(type_).alias(name)
    mine = findings.join(reports.select("dataset_id", "source"), "dataset_id").select("dataset_id", "source", "dimension", "rule", "severity", F.col("occurrences").cast("long").alias("occurrences"), zero("score", "int"), zero("is_clean", "boolean"))
    told = reports.select("dataset_id", "source", zero("dimension", "string"), zero("rule", "string"), zero("severity", "string"), zero("occurrences", "long"), F.col("sanity_score").alias("score"), (sum(F.col(s) for s in SEVERITIES) == 0).alias("is_clean"))
    one = F.when(F.col("rule").isNotNull(), F.col("dataset_id"))
    out = mine.unionByName(told).rollup("source", "dimension", "rule").agg(
        F.grouping_id().cast("int").alias("level"), F.countDistinct(one).alias("datasets"), F.count("severity").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count("score").alias("audited"), F.count_if("is_clean").alias("clean"), F.round(F.avg("score"), 1).alias("mean_score"),
    )
    # On the levels of rules and dimensions the reports are groups without a name.
    named = F.when(F.col("level") == 0, F.col("rule").isNotNull()).when(F.col("level") == 1, F.col("dimension").isNotNull()).otherwise(True)
    above = lambda c: F.when(F.col("level") >= 3, F.col(c)).alias(c)
    return out.filter(named).select("source", "dimension", "rule", "level", "datasets", "findings", *SEVERITIES, "occurrences", above("audited"), above("clean"), above("mean_score"))


def dimension_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dataset_id", "dimension").agg(F.count("*").alias("findings"))


def rule_catalog(spark) -> DataFrame:
    rows = [(r.id, kind, r.block, r.severity, r.dimension, r.description, {k: float(v) for k, v in r.params.items()}) for kind, rules in (("check", CHECK_RULES), ("compare", COMPARE_RULES)) for r in rules.values()]
    return spark.createDataFrame(rows, "id string, kind string, block string, severity string, dimension string, description string, params map<string,double>")

"""Compare two datasets of one instrument: one full outer join by day, and seven rules over it.

pairs: pair_id, a_id, b_id. Occurrences carry the pair_id in the column dataset_id, so that collapse and score are those
of the check.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvet.functions import DAY_MS, finite, utc_day
from tickvet.operators.bands import band_join
from tickvet.operators.catalog import COMPARE_RULES
from tickvet.operators.engine import OCCURRENCES, Config, collapse, computed, scores
from tickvet.operators.tables import MarketTables
from tickvet.shared import written

col, lit = F.col, F.lit


@dataclass
class PairTables:
    pairs: DataFrame
    tables: MarketTables
    cache: bool = False
    _shared: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name, make):
        if name not in self._shared:
            self._shared[name] = written(make()) if self.cache else make()
        return self._shared[name]

    @property
    def aligned(self) -> DataFrame:
        """(dataset_id, day, a_close, b_close, a_volume, b_volume, in_a, in_b); of a day's bars the last in input order counts."""

        def side(s: str) -> DataFrame:
            own = self.pairs.select(col("pair_id").alias("dataset_id"), col(f"{s}_id").alias("id")).join(self.tables.bars.withColumnRenamed("dataset_id", "id"), "id")
            last = own.groupBy("dataset_id", utc_day(col("t"), col("ts_raw")).alias("day")).agg(F.max(F.struct("seq", "close", "volume")).alias("x"))
            return last.select("dataset_id", "day", col("x.close").alias(f"{s}_close"), col("x.volume").alias(f"{s}_volume"), lit(True).alias(f"in_{s}"))

        return self._once("aligned", lambda: side("a").join(side("b"), ["dataset_id", "day"], "full"))

    @property
    def counts(self) -> DataFrame:
        """Of each pair: shared days and days of one side only."""

        def make():
            n = self.aligned.groupBy("dataset_id").agg(F.count_if(col("in_a") & col("in_b")).alias("shared"), F.count_if(col("in_b").isNull()).alias("only_in_a"), F.count_if(col("in_a").isNull()).alias("only_in_b"))
            all_ = self.pairs.select(col("pair_id").alias("dataset_id")).join(n, "dataset_id", "left")
            return all_.select("dataset_id", *(F.coalesce(c, lit(0)).alias(c) for c in ("shared", "only_in_a", "only_in_b")))

        return self._once("counts", make)

    def side(self, table: str, s: str) -> DataFrame:
        return self.pairs.select(col("pair_id").alias("dataset_id"), col(f"{s}_id").alias("id")).join(getattr(self.tables, table).withColumnRenamed("dataset_id", "id"), "id").drop("id")


def occurrences(df, rule, where, value, evidence: dict[str, Column], k1=None, k2=None, severity=None) -> DataFrame:
    level = severity if isinstance(severity, Column) else lit(COMPARE_RULES[rule].severity)
    return df.select(
        "dataset_id", lit(rule).alias("rule"), (k1 if k1 is not None else lit(0)).cast("long").alias("k1"), (k2 if k2 is not None else lit(0)).cast("long").alias("k2"), level.alias("severity"),
        (where if where is not None else lit(None)).cast("string").alias("where_date"), value.cast("double").alias("value"), F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items()))).alias("evidence"),
    )


def symbol_mismatch(t: PairTables, p):
    names = t.tables.datasets.select("dataset_id", F.upper(F.trim("symbol")).alias("s"))
    both = t.pairs.join(names.select(col("dataset_id").alias("a_id"), col("s").alias("sa")), "a_id").join(names.select(col("dataset_id").alias("b_id"), col("s").alias("sb")), "b_id")
    return occurrences(both.filter("sa <> sb").withColumnRenamed("pair_id", "dataset_id"), "SYMBOL_MISMATCH", None, lit(1), {"a": col("sa"), "b": col("sb")})


def insufficient_overlap(t, p):
    hit = t.counts.filter(col("shared") < p["minSharedDates"])
    level = F.when(col("shared") == 0, "critical").otherwise(COMPARE_RULES["INSUFFICIENT_OVERLAP"].severity)
    return occurrences(hit, "INSUFFICIENT_OVERLAP", None, col("shared"), {"shared_dates": col("shared"), "min_shared_dates": lit(p["minSharedDates"]), "only_in_a": col("only_in_a"), "only_in_b": col("only_in_b")}, severity=level)


def _closes(t: PairTables) -> DataFrame:
    a, b = col("a_close"), col("b_close")
    return t.aligned.filter((col("in_a") & col("in_b")) & finite(a) & finite(b) & (a > 0) & (b > 0)).withColumn("d", F.try_divide(F.abs(a - b), F.greatest(a, b)))


def _divergence(rows: DataFrame, shared: DataFrame, least, bound: Column, measure: str) -> DataFrame:
    """Pairs with enough rows whose median measure passes the bound, with the earliest day of the largest measure."""
    worst = F.min(F.struct((-col(measure)).alias("m"), "day"))
    got = rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.median(measure).alias("med"), worst.alias("w"))
    return got.join(shared, "dataset_id").filter((col("n") >= least) & bound)


def close_divergence(t, p):
    hit = _divergence(_closes(t), t.counts.filter(col("shared") >= p["minSharedDates"]), p["minSharedDates"], col("med") > p["medianTolerancePct"], "d")
    return occurrences(hit, "CLOSE_DIVERGENCE", col("w.day"), col("med"), {"median_divergence": col("med"), "worst_divergence": -col("w.m"), "shared_dates": col("shared")})


def price_date_mismatch(t, p):
    enough = t.counts.filter(col("shared") >= p["minSharedDates"]).select("dataset_id")
    hit = _closes(t).filter(col("d") > p["dateTolerancePct"]).join(enough, "dataset_id", "left_semi")
    order = F.unix_millis(F.to_timestamp("day"))
    return occurrences(hit, "PRICE_DATE_MISMATCH", col("day"), col("d"), {"close_a": col("a_close"), "close_b": col("b_close"), "divergence": col("d")}, F.coalesce(order, lit(0)))


def volume_divergence(t, p):
    a, b = col("a_volume"), col("b_volume")
    rows = t.aligned.filter(col("in_a") & col("in_b") & finite(a) & finite(b) & (a > 0) & (b > 0)).withColumn("d", F.try_divide(F.greatest(a, b), F.least(a, b)))
    hit = _divergence(rows, t.counts, p["minSharedDates"], col("med") > p["volumeRatioThreshold"], "d")
    return occurrences(hit, "VOLUME_DIVERGENCE", col("w.day"), col("med"), {"median_ratio": col("med"), "worst_ratio": -col("w.m"), "dates": col("n")})


def _actions(t: PairTables, table: str, measure: Column, window, tolerance, rule: str) -> DataFrame:
    """Each A with its first B within the window: missing in B, or different; then each B without an A."""
    a = t.side(table, "a").withColumn("m", measure)
    b = t.side(table, "b").withColumn("m", measure)
    x = a.select("dataset_id", col("seq").alias("sa"), col("ex_raw").alias("raw"), col("ex_t").alias("ta"), col("m").alias("ma"))
    y = b.select(col("dataset_id").alias("ds"), col("seq").alias("sb"), col("ex_raw").alias("raw_b"), col("ex_t").alias("tb"), col("m").alias("mb"))
    days, near = window * DAY_MS, F.abs(col("ta") - col("tb")) <= window * DAY_MS
    met = band_join(x, y, {"dataset_id": "ds"}, "ta", "tb", -days, days, near, "left").groupBy("dataset_id", "sa", "raw", "ma").agg(F.min(F.when(col("sb").isNotNull(), F.struct("sb", "mb"))).alias("b"))
    off = F.abs(col("ma") - col("b.mb")) / F.when(F.greatest(F.abs("ma"), F.abs("b.mb")) == 0, None).otherwise(F.greatest(F.abs("ma"), F.abs("b.mb")))
    kind = F.when(col("b").isNull(), "missing_in_b").when(finite(off) & (off > tolerance), "differs")
    from_a = met.withColumn("kind", kind).filter("kind IS NOT NULL").select("dataset_id", "raw", col("ma").alias("m"), col("b.mb").alias("other"), "kind", lit(0).alias("k1"), col("sa").alias("k2"))
    alone = band_join(y, x.select("dataset_id", "ta"), {"ds": "dataset_id"}, "tb", "ta", -days, days, near, "left_anti")
    from_b = alone.select(col("ds").alias("dataset_id"), col("raw_b").alias("raw"), col("mb").alias("m"), lit(None).cast("double").alias("other"), lit("missing_in_a").alias("kind"), lit(1).alias("k1"), col("sb").alias("k2"))
    return occurrences(from_a.unionByName(from_b), rule, col("raw"), col("m"), {"kind": col("kind"), "value": col("m"), "other": col("other")}, col("k1"), col("k2"))


def dividend_mismatch(t, p):
    return _actions(t, "dividends", col("amount"), p["matchWindowDays"], p["amountTolerancePct"], "DIVIDEND_MISMATCH")


def split_mismatch(t, p):
    return _actions(t, "splits", F.try_divide("numerator", "denominator"), p["matchWindowDays"], p["ratioTolerancePct"], "SPLIT_MISMATCH")


COMPARES = {
    "SYMBOL_MISMATCH": symbol_mismatch, "INSUFFICIENT_OVERLAP": insufficient_overlap, "CLOSE_DIVERGENCE": close_divergence, "PRICE_DATE_MISMATCH": price_date_mismatch,
    "DIVIDEND_MISMATCH": dividend_mismatch, "SPLIT_MISMATCH": split_mismatch, "VOLUME_DIVERGENCE": volume_divergence,
}


def compare(t: PairTables, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of all pairs. Sources of equal name are told apart as `name (A)` and `name (B)`. All rules run here."""
    t = PairTables(written(t.pairs), t.tables.written(), cache=True)
    findings = computed(COMPARE_RULES, COMPARES, config.compare_rules, t)
    if findings is None:
        findings = collapse(t.pairs.sparkSession.createDataFrame([], OCCURRENCES), COMPARE_RULES, config.compare_rules)
    d = t.tables.datasets.select("dataset_id", "symbol", "source")
    named = t.pairs.join(d.select(col("dataset_id").alias("a_id"), "symbol", col("source").alias("sa")), "a_id").join(d.select(col("dataset_id").alias("b_id"), col("source").alias("sb")), "b_id")
    same = col("sa") == col("sb")
    label = lambda s, x: F.when(same, F.concat(col(s), lit(f" ({x})"))).otherwise(col(s))
    base = named.select(col("pair_id").alias("dataset_id"), "symbol", label("sa", "A").alias("source_a"), label("sb", "B").alias("source_b")).join(t.counts, "dataset_id").withColumnRenamed("shared", "compared_dates")
    return scores(base, findings, "consistency_score"), findings

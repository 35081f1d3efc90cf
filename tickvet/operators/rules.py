"""The 29 rules over one dataset each: (tables, params) -> occurrences.

A rule that looks at one row of a shared table (with its windows) is a RowRule: its occurrences are an array of the row.
All such rules of a table are evaluated in one scan of it (row_occurrences); each can also be called alone. The others join
or aggregate, and are functions.

An occurrence has dataset_id, k1 and k2 (its place among the rule's occurrences), severity, where_date (null: whole
dataset), value (the main measure) and evidence (JSON). Conditions are written so that NaN and null never fire them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvet.functions import COUNTRY_EXCHANGES, DAY_MS, finite, isin_valid, middle, positive, split_label, spread, weekdays_between
from tickvet.functions.numbers import fixed
from tickvet.operators.bands import band_join
from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.tables import MarketTables, as_of, by_seq, by_time

col, lit = F.col, F.lit


def occurrences(df: DataFrame, rule: str, where: Column | None, value: Column, evidence: dict[str, Column], k1: Column | None = None, k2: Column | None = None, severity: Column | str | None = None) -> DataFrame:
    level = severity if isinstance(severity, Column) else lit(severity or CHECK_RULES[rule].severity)
    return df.select(
        "dataset_id", lit(rule).alias("rule"), (k1 if k1 is not None else lit(0)).cast("long").alias("k1"), (k2 if k2 is not None else lit(0)).cast("long").alias("k2"), level.alias("severity"),
        (where if where is not None else lit(None)).cast("string").alias("where_date"), value.cast("double").alias("value"), F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items()))).alias("evidence"),
    )


def hit(rule: str, when: Column, where: Column | None, value: Column, evidence: dict[str, Column], k1: Column | None = None, k2: Column | None = None, severity: Column | None = None) -> Column:
    """The occurrence as a struct if `when` is true, else null."""
    level = severity if severity is not None else lit(CHECK_RULES[rule].severity)
    place = lambda k: (k if k is not None else lit(0)).cast("long")
    fields = (
        lit(rule).alias("rule"),
        place(k1).alias("k1"),
        place(k2).alias("k2"),
        level.alias("severity"),
        (where if where is not None else lit(None)).cast("string").alias("where_date"),
        value.cast("double").alias("value"),
        F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items()))).alias("evidence"),
    )
    return F.when(when, F.struct(*fields))


@dataclass(frozen=True)
class RowRule:
    """A rule over the rows of one shared table.

    hits: from the parameters, the row's possible occurrences (null where there is none). columns: steps of helper columns
    that hits need, each step over the one before; names are the rule's own.
    """

    source: str  # a table of MarketTables; with others, rules of bars are evaluated over enriched, which has their columns
    hits: Callable[[Mapping[str, float]], list[Column]]
    columns: Callable[[Mapping[str, float]], list[dict[str, Column]]] = lambda p: []

    def __call__(self, t: MarketTables, p: Mapping[str, float]) -> DataFrame:
        return row_occurrences(t, self.source, [(self, p)])


def row_occurrences(t: MarketTables, source: str, rules: list[tuple[RowRule, Mapping[str, float]]]) -> DataFrame:
    """The occurrences of all these rules, in one scan of their table."""
    rows, steps = getattr(t, source), [rule.columns(p) for rule, p in rules]
    for i in range(max(map(len, steps))):
        rows = rows.withColumns({k: c for own in steps if i < len(own) for k, c in own[i].items()})
    found = F.array_compact(F.array(*(h for rule, p in rules for h in rule.hits(p))))
    return rows.select("dataset_id", F.explode(found).alias("o")).select("dataset_id", "o.*")


def split_evidence() -> dict[str, Column]:
    volumes = F.when((col("volume") != 0) & (col("p_volume") > 0), fixed(F.try_divide(col("volume"), col("p_volume")), 2))
    return {"return": fixed("ret", 4), "hypothesized_ratio": col("ratio"), "previous_close": col("p_close"), "close": col("close"), "volume_ratio": volumes}


def split_not_adjusted(t: MarketTables, p) -> DataFrame:
    moved = t.enriched.withColumn("ratio", split_label(col("ret"), p["tolerance"])).filter("ratio IS NOT NULL")
    splits, days = t.splits.select(col("dataset_id").alias("ds"), col("ex_t").alias("split_t")), p["splitWindowDays"] * DAY_MS
    found = band_join(moved, splits, {"dataset_id": "ds"}, "t", "split_t", -days, days, F.abs(col("split_t") - col("t")) <= days, "left_anti")
    return occurrences(found, "SPLIT_NOT_ADJUSTED", col("ts_raw"), col("ret"), split_evidence(), col("seq"))


def _return_z() -> Column:
    return F.when(col("ret_mad") == 0, 0.0).otherwise(F.try_divide(0.6745 * (col("ret") - col("ret_median")), col("ret_mad")))


def _return_spike(p) -> list[Column]:
    z = col("return_z")
    when = (col("ret_count") >= p["minReturns"]) & finite(col("ret")) & (F.abs("ret") >= p["minReturnPct"]) & (F.abs(z) > p["zscoreThreshold"]) & split_label(col("ret"), p["splitTolerance"]).isNull()
    level = F.when((F.abs(z) >= 5) | (F.abs("ret") >= 0.08), CHECK_RULES["RETURN_SPIKE"].severity).otherwise("info")
    return [hit("RETURN_SPIKE", when, col("ts_raw"), z, {"return": fixed("ret", 4), "modified_zscore": fixed(z, 2)}, col("seq"), severity=level)]


return_spike = RowRule("enriched", _return_spike, lambda p: [{"return_z": _return_z()}])


def _near(p) -> list[dict[str, Column]]:
    w = int(p["window"])
    good = F.when(positive(col("close")), col("close"))
    near = F.concat(F.collect_list(good).over(by_seq().rowsBetween(-w, -1)), F.collect_list(good).over(by_seq().rowsBetween(1, w)))
    inner = col("p_seq").isNotNull() & col("n_seq").isNotNull() & finite(col("close")) & (F.size("near") >= 3)
    return [{"near": near}, {"near_med": F.when(inner, middle(col("near")))}, {"near_sigma": F.when(col("near_med").isNotNull(), 1.4826 * spread(col("near"), col("near_med")))}]


def _price_spike(p) -> list[Column]:
    med, sigma = col("near_med"), col("near_sigma")
    far = lambda c: F.abs(c - med) > p["theta"] * sigma
    when = (sigma > 0) & far(col("close")) & ~(finite(col("p_close")) & far(col("p_close"))) & (F.try_divide(F.abs(col("close") - med), med) >= p["minDeviationPct"]) & positive(col("n_close")) & ~far(col("n_close"))
    away = F.try_divide(col("close") - med, med) * 100
    return [hit("PRICE_SPIKE_INTRADAY", when, col("ts_raw"), F.abs(away), {"close": col("close"), "neighborhood_median": med, "deviation_pct": fixed(away, 2), "reverted_to": col("n_close")}, col("seq"))]


price_spike_intraday = RowRule("enriched", _price_spike, _near)


def _price_nonpositive(p) -> list[Column]:
    return [hit("PRICE_NONPOSITIVE", ~positive(col(f)), col("ts_raw"), col(f), {"field": lit(f), "value": col(f).cast("string")}, col("seq"), lit(i)) for i, f in enumerate(("open", "high", "low", "close"))]


price_nonpositive = RowRule("bars", _price_nonpositive)


def _insufficient_data(p) -> list[Column]:
    level = F.when(col("n") == 0, "critical").otherwise(CHECK_RULES["INSUFFICIENT_DATA"].severity)
    return [hit("INSUFFICIENT_DATA", col("n") < p["minBars"], None, col("n"), {"bars": col("n"), "min_bars": lit(p["minBars"])}, severity=level)]


insufficient_data = RowRule("facts", _insufficient_data)


def _ohlc_inconsistent(p) -> list[Column]:
    known = finite(col("open")) & finite(col("high")) & finite(col("low")) & finite(col("close"))
    outside = lambda c: (col(c) < col("low")) | (col(c) > col("high"))
    checks = (("high_below_low", col("high") < col("low")), ("open_outside", outside("open")), ("close_outside", outside("close")))
    prices = {c: col(c) for c in ("open", "high", "low", "close")}
    return [hit("OHLC_INCONSISTENT", known & when, col("ts_raw"), lit(i), {"check": lit(name), **prices}, col("seq"), lit(i)) for i, (name, when) in enumerate(checks)]


ohlc_inconsistent = RowRule("bars", _ohlc_inconsistent)


def _volume_negative(p) -> list[Column]:
    when = col("volume").isNotNull() & ~(finite(col("volume")) & (col("volume") >= 0))
    return [hit("VOLUME_NEGATIVE", when, col("ts_raw"), col("volume"), {"volume": col("volume").cast("string")}, col("seq"))]


volume_negative = RowRule("bars", _volume_negative)


def _zero_volume_moved(p) -> list[Column]:
    when = (col("volume") == 0) & finite(col("high")) & finite(col("low")) & (col("high") != col("low"))
    return [hit("ZERO_VOLUME_MOVED", when, col("ts_raw"), col("high") - col("low"), {"high": col("high"), "low": col("low")}, col("seq"))]


zero_volume_moved = RowRule("bars", _zero_volume_moved)


def _same_time(p) -> list[dict[str, Column]]:
    # By dataset and time: rows dealt by dataset need no other shuffle.
    same = Window.partitionBy("dataset_id", F.coalesce(col("t").cast("string"), F.concat(lit("raw:"), "ts_raw")))
    return [{"same_n": F.count("*").over(same), "same_first": F.min("seq").over(same)}]


def _ts_duplicated(p) -> list[Column]:
    when = (col("same_n") > 1) & (col("seq") == col("same_first"))
    return [hit("TS_DUPLICATED", when, col("ts_raw"), col("same_n"), {"count": col("same_n")}, col("seq"))]


ts_duplicated = RowRule("enriched", _ts_duplicated, _same_time)


def _ts_unordered(p) -> list[Column]:
    return [hit("TS_UNORDERED", col("t") < col("p_t"), col("ts_raw"), (col("p_t") - col("t")) / DAY_MS, {"previous": col("p_raw"), "current": col("ts_raw")}, col("seq"))]


ts_unordered = RowRule("enriched", _ts_unordered)


def _bar_missing(p) -> list[Column]:
    gap = col("gap_weekdays")
    return [hit("BAR_MISSING", gap >= p["minMissingWeekdays"], col("ts_raw"), gap, {"gap_weekdays": gap, "from": col("p_raw"), "to": col("ts_raw")}, col("seq"))]


bar_missing = RowRule("enriched", _bar_missing, lambda p: [{"gap_weekdays": F.when(col("t") > col("p_t"), weekdays_between(col("p_t"), col("t")))}])


def _runs(p) -> list[dict[str, Column]]:
    breaks = F.when(col("p_seq").isNull() | col("close").isNull() | col("p_close").isNull() | F.isnan("close") | F.isnan("p_close") | (col("close") != col("p_close")), 1).otherwise(0)
    run = Window.partitionBy("dataset_id", "run")  # a bar without a number is a run by itself
    traded = F.max(F.when(col("volume").isNull() | (col("volume") > 0), 1).otherwise(0)).over(run)
    return [{"run": F.sum(breaks).over(by_seq())}, {"run_n": F.count("*").over(run), "run_from": F.min(F.struct("seq", "ts_raw")).over(run), "run_last": F.max("seq").over(run), "run_traded": traded}]


def _stale_price(p) -> list[Column]:
    when = ~F.isnan("close") & (col("seq") == col("run_last")) & (col("run_n") >= p["consecutiveSessions"]) & (col("run_traded") == 1)
    return [hit("STALE_PRICE", when, col("ts_raw"), col("run_n"), {"sessions": col("run_n"), "close": col("close"), "from": col("run_from.ts_raw"), "to": col("ts_raw")}, col("seq"))]


stale_price = RowRule("enriched", _stale_price, _runs)


def _around(p) -> list[dict[str, Column]]:
    k = int(p["minRunSessions"])
    good = F.when(positive(col("close")), col("close"))
    low, high = 100 * (1 - p["scaleTolerance"]), 100 * (1 + p["scaleTolerance"])
    band = lambda r: F.when((r >= low) & (r <= high), "up").when((r >= 1 / high) & (r <= 1 / low), "down")
    way = F.when(positive(col("close")) & positive(col("p_close")), band(F.try_divide(col("close"), col("p_close"))))
    sides = {"scale_before": F.collect_list(good).over(by_seq().rowsBetween(-k, -1)), "scale_after": F.collect_list(good).over(by_seq().rowsBetween(0, k - 1)), "scale_way": way}
    medians = {f"med_{x}": F.when(col("scale_way").isNotNull(), middle(col(f"scale_{x}"))) for x in ("before", "after")}
    return [sides, medians, {"scale_same": band(F.try_divide("med_after", "med_before")) == col("scale_way")}]


def _currency_scale(p) -> list[Column]:
    before, after = col("med_before"), col("med_after")
    factor = F.when(col("scale_way") == "up", F.try_divide(after, before)).otherwise(F.try_divide(before, after))
    return [hit("CURRENCY_SCALE_SUSPECT", col("scale_same"), col("ts_raw"), factor, {"scale_factor": fixed(factor, 1), "direction": col("scale_way"), "median_before": fixed(before, 4), "median_after": fixed(after, 4)}, col("seq"))]


currency_scale_suspect = RowRule("enriched", _currency_scale, _around)


def div_duplicated(t, p):
    a = t.dividends.select("dataset_id", col("seq").alias("i"), "amount", col("ex_t").alias("t_a"), col("ex_raw").alias("first"))
    b = t.dividends.select(col("dataset_id").alias("ds"), col("seq").alias("j"), col("amount").alias("other"), col("ex_t").alias("t_b"), col("ex_raw").alias("second"))
    scale = F.greatest(F.abs("amount"), F.abs("other"))
    same = F.when(scale == 0, col("amount") == col("other")).otherwise(F.try_divide(F.abs(col("amount") - col("other")), scale) <= p["amountTolerancePct"])
    days, most = F.abs(col("t_a") - col("t_b")) / DAY_MS, p["windowDays"] * DAY_MS
    found = band_join(a, b, {"dataset_id": "ds"}, "t_a", "t_b", -most, most, (col("i") < col("j")) & (days <= p["windowDays"]) & finite(scale) & same)
    evidence = {"amount": col("amount"), "first_exDate": col("first"), "duplicate_exDate": col("second"), "days_apart": F.floor(days + 0.5)}
    return occurrences(found, "DIV_DUPLICATED", col("second"), col("amount"), evidence, col("i"), col("j"))


def _yielded() -> Column:
    return (col("idx") >= 1) & positive(col("amount")) & positive(col("prev_close"))


def _exdate_after_paydate(p) -> list[Column]:
    large = F.coalesce(_yielded() & (col("amount") >= p["largeDividendPct"] * col("prev_close")), lit(False))
    return [hit("EXDATE_AFTER_PAYDATE", (col("pay_t") < col("ex_t")) & ~large, col("ex_raw"), (col("ex_t") - col("pay_t")) / DAY_MS, {"exDate": col("ex_raw"), "payDate": col("pay_raw"), "amount": col("amount")}, col("seq"))]


exdate_after_paydate = RowRule("paid", _exdate_after_paydate)


def exdate_misplaced(t, p):
    d = t.paid.filter((col("idx") >= 1) & positive(col("amount")) & positive(col("prev_close")) & positive(col("ex_close")))
    d = d.withColumns({"expected": F.try_divide(col("amount"), col("prev_close")), "actual": F.try_divide(col("prev_close"), col("ex_close")) - 1})
    d = d.filter((col("expected") >= p["minExpectedDropPct"]) & (col("actual") < p["minMatchRatio"] * col("expected")))
    drops = t.enriched.select("dataset_id", "rn", "ts_raw", "close", F.lag("close").over(by_time()).alias("before")).filter(positive(col("close")) & positive(col("before")))
    drops = drops.select(col("dataset_id").alias("ds"), "rn", col("ts_raw").alias("at"), (F.try_divide(col("before"), col("close")) - 1).alias("drop"))
    fits = (col("drop") >= p["minMatchRatio"] * col("expected")) & (col("drop") <= p["maxMatchRatio"] * col("expected"))
    found = band_join(d, drops, {"dataset_id": "ds"}, "idx", "rn", 1, int(p["searchWindowSessions"]), fits)
    hit = found.groupBy("dataset_id", "seq", "ex_raw", "expected", "actual").agg(F.min(F.struct("rn", "at")).alias("m"))
    return occurrences(hit, "EXDATE_MISPLACED", col("ex_raw"), col("expected") * 100, {"expected_drop_pct": fixed(col("expected") * 100, 2), "actual_drop_pct": fixed(col("actual") * 100, 2), "matched_date": col("m.at")}, col("seq"))


def div_not_adjusted(t, p):
    before = F.collect_list("adj_factor").over(by_time().rowsBetween(-4, 0))
    known = t.factored.select("dataset_id", "rn", before.alias("f"))
    d = t.paid.filter((col("idx") >= 1) & positive(col("amount")) & positive(col("prev_close"))).withColumn("expected", F.try_divide(col("amount"), col("prev_close")))
    d = d.filter(col("expected") >= p["minAdjustmentPct"])
    k = known.select(col("dataset_id").alias("ds"), col("rn").alias("frn"), "f")
    # The last factored bar before the ex-date bar: an as-of join on places instead of times.
    events = d.select("dataset_id", "seq", "ex_raw", "amount", "expected", (col("idx") - 1).cast("long").alias("ex_t"))
    hit = as_of(events, k.select(col("ds").alias("dataset_id"), col("frn").cast("long").alias("t"), col("frn").alias("rn"), "f"))
    hit = hit.filter(F.size("bar.f") >= p["minBarsBefore"]).withColumn("med", middle(col("bar.f"))).filter(1 - col("med") < p["underAdjustmentRatio"] * col("expected"))
    return occurrences(hit, "DIV_NOT_ADJUSTED", col("ex_raw"), col("med"), {"median_factor_before": fixed("med", 6), "dividend_amount": col("amount"), "expected_adjustment_pct": fixed(col("expected") * 100, 3), "observed_adjustment_pct": fixed((1 - col("med")) * 100, 3)}, col("seq"))


def _div_scale_100x(p) -> list[Column]:
    y = F.try_divide(col("amount"), col("prev_close"))
    special = F.coalesce(col("div_type") == "special", lit(False))
    level = F.when(special, "info").otherwise(CHECK_RULES["DIV_SCALE_100X"].severity)
    return [hit("DIV_SCALE_100X", _yielded() & (y > p["maxSingleYieldPct"]), col("ex_raw"), y, {"amount": col("amount"), "prev_close": col("prev_close"), "single_yield_pct": y, "hypothesized_amount": F.when(~special, col("amount") / 100)}, col("seq"), severity=level)]


div_scale_100x = RowRule("paid", _div_scale_100x)


def div_yield_impossible(t, p):
    year = t.dividends.filter(F.coalesce(col("div_type"), lit("regular")) == "regular").join(t.last, "dataset_id").filter((col("ex_t") <= col("last_t")) & (col("ex_t") >= col("last_t") - 365 * DAY_MS))
    # summed in input order, so that the sum does not depend on the shuffle
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "amount"))), lit(0.0), lambda a, x: a + x["amount"])
    hit = year.groupBy("dataset_id", "last_raw", "close").agg(total.alias("ttm")).withColumn("y", F.try_divide("ttm", "close")).filter(finite(col("y")) & (col("y") > p["maxAnnualYieldPct"]))
    return occurrences(hit, "DIV_YIELD_IMPOSSIBLE", col("last_raw"), col("y"), {"ttm_dividends": col("ttm"), "close": col("close"), "ttm_yield_pct": col("y")})


def div_special_misclassified(t, p):
    d = t.dividends.filter("ex_t IS NOT NULL")
    mine = d.filter((col("div_type") == "regular") & positive(col("amount")))
    peers = mine.select(col("dataset_id").alias("ds"), col("seq").alias("s"), col("ex_t").alias("x"), col("amount").alias("a"))
    with_peers = band_join(mine, peers, {"dataset_id": "ds"}, "ex_t", "x", -1095 * DAY_MS, -1, col("s") != col("seq"))
    hit = with_peers.groupBy("dataset_id", "seq", "ex_raw", "ex_t", "amount").agg(F.count("*").alias("n"), F.median("a").alias("peer"))
    hit = hit.filter((col("n") >= p["minPeers"]) & (col("amount") > p["magnitudeRatio"] * col("peer")))
    others = d.select(col("dataset_id").alias("ds"), col("seq").alias("s"), col("ex_t").alias("x"))
    alone = p["isolationDays"] * DAY_MS
    hit = band_join(hit, others, {"dataset_id": "ds"}, "ex_t", "x", -alone, alone, (col("s") != col("seq")) & (F.abs(col("x") - col("ex_t")) <= alone), "left_anti")
    ratio = F.try_divide(col("amount"), col("peer"))
    return occurrences(hit, "DIV_SPECIAL_MISCLASSIFIED", col("ex_raw"), ratio, {"amount": col("amount"), "peer_median": col("peer"), "ratio": fixed(ratio, 2)}, col("seq"))


def _split_ratio(p) -> list[Column]:
    ratio = F.when(positive(col("numerator")) & positive(col("denominator")), F.try_divide(col("numerator"), col("denominator")))
    near = F.abs(col("numerator") - col("denominator")) <= p["nearOneTolerance"] * col("denominator")
    reason = F.when(ratio == 1, "identity").when(ratio.isNotNull() & near, "near_one").when((ratio >= p["extremeRatio"]) | (ratio <= 1 / p["extremeRatio"]), "extreme")
    level = F.when(reason == "near_one", "info").otherwise(CHECK_RULES["SPLIT_RATIO_IMPROBABLE"].severity)
    return [hit("SPLIT_RATIO_IMPROBABLE", reason.isNotNull(), col("ex_raw"), ratio, {"numerator": col("numerator"), "denominator": col("denominator"), "ratio": ratio, "reason": reason}, col("seq"), severity=level)]


split_ratio_improbable = RowRule("splits", _split_ratio)


def action_missing_from_factor(t, p):
    events = t.dividends.select("dataset_id", "ex_t", lit(1).alias("d")).unionByName(t.splits.select("dataset_id", "ex_t", lit(0).alias("d")))
    last = events.groupBy("dataset_id").agg(F.max("ex_t").alias("last_event"), F.sum("d").alias("dividends"), F.sum(1 - col("d")).alias("splits"))
    b = t.factored.join(last, "dataset_id", "left").filter(col("last_event").isNull() | (col("t") > col("last_event")))
    hit = b.groupBy("dataset_id").agg(F.count("*").alias("n"), F.median("adj_factor").alias("med"), F.min(F.struct("rn", "ts_raw")).alias("f"), F.coalesce(F.first("dividends"), lit(0)).alias("dividends"), F.coalesce(F.first("splits"), lit(0)).alias("splits"))
    hit = hit.filter((col("n") >= max(1, p["minBarsAfter"])) & (col("med") < 1 - p["factorDeviationTolerance"]))
    return occurrences(hit, "CORPORATE_ACTION_MISSING_FROM_FACTOR", col("f.ts_raw"), col("med"), {"median_factor": fixed("med", 6), "bars_examined": col("n"), "registered_dividends": col("dividends"), "registered_splits": col("splits")})


def _marketcap_mismatch(p) -> list[Column]:
    implied = col("shares_outstanding") * col("close")
    off = F.try_divide(F.abs(col("market_cap") - implied), col("market_cap"))
    when = positive(col("market_cap")) & positive(col("shares_outstanding")) & col("close").isNotNull() & (off > p["tolerancePct"])
    return [hit("MARKETCAP_MISMATCH", when, col("last_raw"), off, {"marketCap": col("market_cap"), "implied_market_cap": implied, "deviation_pct": fixed(off * 100, 2)})]


marketcap_mismatch = RowRule("facts", _marketcap_mismatch)


def _pe_eps(p) -> list[Column]:
    implied = F.when(col("eps") == 0, lit(float("inf"))).otherwise(F.try_divide("close", "eps"))
    clash = ((col("eps") <= 0) & (col("pe") > 0)) | ((col("eps") > 0) & (col("pe") < 0))
    off = (col("eps") > 0) & (col("pe") > 0) & (F.abs(col("pe") - implied) / F.when(col("pe") == 0, None).otherwise(col("pe")) > p["tolerancePct"])
    when = finite(col("pe")) & finite(col("eps")) & col("close").isNotNull() & (clash | F.coalesce(off, lit(False)))
    return [hit("PE_EPS_INCOMPATIBLE", when, col("last_raw"), col("pe"), {"pe": col("pe"), "eps": col("eps"), "close": col("close"), "implied_pe": implied.cast("string")})]


pe_eps_incompatible = RowRule("facts", _pe_eps)


def _payout(p) -> list[Column]:
    ratio = col("payout_ratio")
    return [hit("PAYOUT_IMPOSSIBLE", (col("n") > 0) & finite(ratio) & ((ratio < 0) | (ratio > p["maxPayout"])), col("last_raw"), ratio, {"payout_ratio": ratio})]


payout_impossible = RowRule("facts", _payout)


def _sign_validity(p) -> list[Column]:
    fields = (("marketCap", col("market_cap")), ("sharesOutstanding", col("shares_outstanding")))
    return [hit("FUNDAMENTALS_SIGN_VALIDITY", v.isNotNull() & ~positive(v), col("last_raw"), v, {"field": lit(name), "value": v.cast("string")}, lit(i)) for i, (name, v) in enumerate(fields)]


sign_validity = RowRule("facts", _sign_validity)


def _currency_suspect(p) -> list[Column]:
    med, known = col("median_close"), col("currency").isNotNull()
    pence = (col("currency") == "GBP") & F.endswith(col("symbol"), lit(".L")) & (med > p["penceMagnitudeThreshold"])
    level = F.when(known, CHECK_RULES["CURRENCY_SUSPECT"].severity).otherwise("info")
    return [hit("CURRENCY_SUSPECT", ~known | F.coalesce(pence, lit(False)), F.when(known, col("last_raw")), F.when(known, med), {"currency": col("currency"), "median_close": F.when(known, med)}, severity=level)]


currency_suspect = RowRule("facts", _currency_suspect)


def _symbol_mapping(p) -> list[Column]:
    country = F.create_map(*(x for c, names in COUNTRY_EXCHANGES.items() for e in names for x in (lit(e), lit(c))))
    at, isin = F.try_element_at(country, F.upper("exchange")), col("isin")
    kinds = (isin.isNotNull() & ~isin_valid(isin), isin.isNotNull() & (at != F.substring(isin, 1, 2)))
    return [hit("SYMBOL_MAPPING_SUSPECT", when, None, lit(i), {"isin": isin, "exchange": col("exchange"), "exchange_country": at}, lit(i)) for i, when in enumerate(kinds)]


symbol_mapping_suspect = RowRule("facts", _symbol_mapping)


def dividend_fx_mismatch(t, p):
    d = t.dividends.select("dataset_id", "seq", "ex_raw", "amount", col("currency").alias("paid_in")).join(t.datasets.select("dataset_id", "currency"), "dataset_id").filter("paid_in <> currency")
    hit = d.groupBy("dataset_id", "paid_in", "currency").agg(F.min(F.struct("seq", "ex_raw", "amount")).alias("f"))
    return occurrences(hit, "DIVIDEND_FX_MISMATCH", col("f.ex_raw"), col("f.amount"), {"dividend_currency": col("paid_in"), "series_currency": col("currency")}, col("f.seq"))


CHECKS = {
    "SPLIT_NOT_ADJUSTED": split_not_adjusted, "RETURN_SPIKE": return_spike, "PRICE_SPIKE_INTRADAY": price_spike_intraday, "PRICE_NONPOSITIVE": price_nonpositive, "INSUFFICIENT_DATA": insufficient_data,
    "OHLC_INCONSISTENT": ohlc_inconsistent, "VOLUME_NEGATIVE": volume_negative, "ZERO_VOLUME_MOVED": zero_volume_moved, "TS_DUPLICATED": ts_duplicated, "TS_UNORDERED": ts_unordered, "BAR_MISSING": bar_missing,
    "STALE_PRICE": stale_price, "CURRENCY_SCALE_SUSPECT": currency_scale_suspect, "DIV_DUPLICATED": div_duplicated, "EXDATE_AFTER_PAYDATE": exdate_after_paydate, "EXDATE_MISPLACED": exdate_misplaced,
    "DIV_NOT_ADJUSTED": div_not_adjusted, "DIV_SCALE_100X": div_scale_100x, "DIV_YIELD_IMPOSSIBLE": div_yield_impossible, "DIV_SPECIAL_MISCLASSIFIED": div_special_misclassified,
    "SPLIT_RATIO_IMPROBABLE": split_ratio_improbable, "CORPORATE_ACTION_MISSING_FROM_FACTOR": action_missing_from_factor, "MARKETCAP_MISMATCH": marketcap_mismatch, "PE_EPS_INCOMPATIBLE": pe_eps_incompatible,
    "PAYOUT_IMPOSSIBLE": payout_impossible, "FUNDAMENTALS_SIGN_VALIDITY": sign_validity, "CURRENCY_SUSPECT": currency_suspect, "SYMBOL_MAPPING_SUSPECT": symbol_mapping_suspect, "DIVIDEND_FX_MISMATCH": dividend_fx_mismatch,
}

"""Deterministic market data from the tables events and customer, for Spark and (as CTEs) for DuckDB.

Three families of datasets: u - a user's daily bars; e - a bar for each event, out of order and dirty; v - u from another
source, which lacks some events and rounds otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvet.functions import DAY_MS
from tickvet.functions.numbers import scaled
from tickvet.operators.compare import PairTables
from tickvet.operators.tables import MarketTables


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value", "props")
    return e.select("event_id", "user_id", F.to_date("ts").alias("d"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _day_ms(d):
    return F.unix_date(d).cast("long") * DAY_MS


def _daily(e: DataFrame, family: str) -> DataFrame:
    first, last = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    close = last if family == "u" else F.when(F.col("user_id") % 3 == 0, scaled(F.avg("value"), 4)).otherwise(last)
    b = e.groupBy("user_id", "d").agg(first.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), close.alias("close"), F.count("*").alias("n"))
    scale = F.when((F.col("user_id") % 11 == 0) & (F.col("d") >= F.lit("2024-01-16").cast("date")), 0.01).otherwise(1.0)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("d")) - 1
    factor = F.when(F.col("user_id") % 5 != 0, 0.9 + (F.col("n") % 5) / 50.0)
    volume = F.col("n").cast("double") * (1 if family == "u" else F.when(F.col("user_id") % 4 == 0, 3).otherwise(1))
    return b.select(F.concat(F.lit(family), F.col("user_id").cast("string")).alias("dataset_id"), seq.cast("int").alias("seq"), F.col("d").cast("string").alias("ts_raw"), _day_ms(F.col("d")).alias("t"), *((F.col(c) * scale).alias(c) for c in ("open", "high", "low", "close")), volume.cast("double").alias("volume"), factor.alias("adj_factor"))


def tables(spark: SparkSession, sf_dir: str, families: str = "ue") -> MarketTables:
    e = _events(spark, sf_dir)
    bars, dividends, splits = [], [], []
    for f in families:
        ds = F.concat(F.lit(f), F.col("user_id").cast("string")).alias("dataset_id")
        if f == "e":
            seq = F.row_number().over(Window.partitionBy("user_id").orderBy("k", "event_id")) - 1
            k, v = F.col("k"), F.col("value")
            close = F.when(k % 10 < 5, F.floor(v / 250) * 250.0).otherwise(v - 5)
            bars.append(e.select(ds, seq.cast("int").alias("seq"), F.col("d").cast("string").alias("ts_raw"), _day_ms(F.col("d")).alias("t"), v.alias("open"), (v + k % 7 - 2).alias("high"), (v - k % 5).alias("low"), close.alias("close"), F.when(k % 17 != 0, (k - 3).cast("double")).alias("volume"), F.lit(None).cast("double").alias("adj_factor")))
            continue
        own = e if f == "u" else e.filter("event_type <> 'error'")
        bars.append(_daily(own, f))
        by_event = Window.partitionBy("user_id").orderBy("event_id")
        ex = [F.col("d").cast("string").alias("ex_raw"), _day_ms(F.col("d")).alias("ex_t")]
        paid = e.filter("event_type = 'purchase'" + ("" if f == "u" else " AND k % 7 <> 0")).withColumn("seq", (F.row_number().over(by_event) - 1).cast("int"))
        pay = F.date_add("d", F.col("k") - 20)
        amount = F.floor(F.col("value") / 10) / 10 * F.when(F.col("k") % 9 == 0, 20.0).otherwise(1.0) * (1.0 if f == "u" else F.when(F.col("k") % 3 == 0, 1.5).otherwise(1.0))
        dividends.append(paid.select(ds, "seq", *ex, pay.cast("string").alias("pay_raw"), _day_ms(pay).alias("pay_t"), amount.alias("amount"), F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), F.col("k") % 3 + 1).alias("currency"), F.when(F.col("k") % 4 == 0, "special").when(F.col("k") % 4 < 3, "regular").alias("div_type")))
        cut = e.filter("event_type = 'signup'" + ("" if f == "u" else " AND k % 5 <> 0")).withColumn("seq", (F.row_number().over(by_event) - 1).cast("int"))
        splits.append(cut.select(ds, "seq", *ex, (F.lit(1.0) + F.col("k") % 25 + (0.0 if f == "u" else F.when(F.col("k") % 4 == 0, 1.0).otherwise(0.0))).alias("numerator"), (F.lit(1.0) + F.floor(F.col("k") / 25)).cast("double").alias("denominator")))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_nationkey", "c_mktsegment")
    users = e.select("user_id").distinct().join(customers, "user_id", "left")
    n, u = F.col("c_nationkey"), F.col("user_id")
    parts = [users.select(
        F.concat(F.lit(f), u.cast("string")).alias("dataset_id"), F.concat(F.lit("S"), (u if f != "v" else F.when(u % 13 == 0, u + 1).otherwise(u)).cast("string"), F.when(u % 2 == 0, ".L").otherwise("")).alias("symbol"), F.lit(f"feed_{f}").alias("source"),
        F.element_at(F.array(*map(F.lit, ("NYSE", "LSE", "XETRA", "sto", "OTC"))), (u % 5 + 1).cast("int")).alias("exchange"), F.when(u % 6 != 0, F.element_at(F.array(*map(F.lit, ("GBP", "USD"))), (u % 2 + 1).cast("int"))).alias("currency"),
        F.when(u % 3 == 0, "US0378331005").when(u % 3 == 1, "US0378331006").alias("isin"), F.col("c_acctbal").alias("market_cap"), F.when(u % 7 == 0, -1.0).otherwise(u % 50 + 1.0).cast("double").alias("shares_outstanding"),
        (n - 5.0).cast("double").alias("eps"), (n * 3.0 - 10).cast("double").alias("pe"), F.lit(None).cast("double").alias("dividend_yield"), (n / 4.0 - 1).cast("double").alias("payout_ratio"),
    ) for f in families]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return MarketTables(union(parts), union(bars), union(dividends), union(splits))


def pair_tables(spark: SparkSession, sf_dir: str) -> PairTables:
    t = tables(spark, sf_dir, "uv")
    pairs = t.datasets.filter("dataset_id LIKE 'u%'").select(F.substring("dataset_id", 2, 20).alias("pair_id"), F.col("dataset_id").alias("a_id"), F.concat(F.lit("v"), F.substring("dataset_id", 2, 20)).alias("b_id"))
    return PairTables(pairs, t)


def _sql_family(f: str) -> tuple[str, str, str]:
    if f == "e":
        return """SELECT 'e' || user_id AS dataset_id, (row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) - 1)::INT AS seq, d::VARCHAR AS ts_raw, d AS t, value AS open, value + k % 7 - 2 AS high, value - k % 5 AS low,
CASE WHEN k % 10 < 5 THEN floor(value / 250) * 250.0 ELSE value - 5 END::DOUBLE AS close, CASE WHEN k % 17 <> 0 THEN (k - 3)::DOUBLE END AS volume, NULL::DOUBLE AS adj_factor FROM ev""", "", ""
    where = "" if f == "u" else "WHERE event_type <> 'error'"
    close = "last_v" if f == "u" else "CASE WHEN user_id % 3 = 0 THEN round(mean_v, 4) ELSE last_v END"
    volume = "n" if f == "u" else "n * CASE WHEN user_id % 4 = 0 THEN 3 ELSE 1 END"
    scale = "CASE WHEN user_id % 11 = 0 AND d >= DATE '2024-01-16' THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END"
    bars = f"""SELECT '{f}' || user_id AS dataset_id, (row_number() OVER (PARTITION BY user_id ORDER BY d) - 1)::INT AS seq, d::VARCHAR AS ts_raw, d AS t, open * sc AS open, high * sc AS high, low * sc AS low, ({close}) * sc AS close, ({volume})::DOUBLE AS volume, CASE WHEN user_id % 5 <> 0 THEN 0.9::DOUBLE + (n % 5) / 50.0::DOUBLE END AS adj_factor
FROM (SELECT user_id, d, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS last_v, avg(value) AS mean_v, count(*) AS n, {scale} AS sc FROM ev {where} GROUP BY user_id, d)"""
    paid = "" if f == "u" else "AND k % 7 <> 0"
    more = "1.0::DOUBLE" if f == "u" else "CASE WHEN k % 3 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
    dividends = f"""SELECT '{f}' || user_id AS dataset_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS seq, d::VARCHAR AS ex_raw, d AS ex_t, (d + (k - 20))::VARCHAR AS pay_raw, d + (k - 20) AS pay_t, floor(value / 10) / 10 * CASE WHEN k % 9 = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END * {more} AS amount, ['USD', 'EUR', 'GBP'][k % 3 + 1] AS currency, CASE WHEN k % 4 = 0 THEN 'special' WHEN k % 4 < 3 THEN 'regular' END AS div_type
FROM ev WHERE event_type = 'purchase' {paid}"""
    cut = "" if f == "u" else "AND k % 5 <> 0"
    plus = "0" if f == "u" else "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END"
    splits = f"SELECT '{f}' || user_id AS dataset_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS seq, d::VARCHAR AS ex_raw, d AS ex_t, (1 + k % 25 + {plus})::DOUBLE AS numerator, (1 + k // 25)::DOUBLE AS denominator FROM ev WHERE event_type = 'signup' {cut}"
    return bars, dividends, splits


def ctes(families: str = "ue") -> str:
    """WITH ev, bars, dividends, splits, datasets AS ... for DuckDB; times are dates."""
    got = [_sql_family(f) for f in families]
    union = lambda i: " UNION ALL ".join(g[i] for g in got if g[i])
    datasets = " UNION ALL ".join(
        f"""SELECT '{f}' || u AS dataset_id, 'S' || {'u' if f != 'v' else 'CASE WHEN u % 13 = 0 THEN u + 1 ELSE u END'} || CASE WHEN u % 2 = 0 THEN '.L' ELSE '' END AS symbol, 'feed_{f}' AS source, ['NYSE', 'LSE', 'XETRA', 'sto', 'OTC'][u % 5 + 1] AS exchange, CASE WHEN u % 6 <> 0 THEN ['GBP', 'USD'][u % 2 + 1] END AS currency, CASE u % 3 WHEN 0 THEN 'US0378331005' WHEN 1 THEN 'US0378331006' END AS isin,
c_acctbal AS market_cap, CASE WHEN u % 7 = 0 THEN -1.0 ELSE u % 50 + 1.0 END::DOUBLE AS shares_outstanding, (c_nationkey - 5)::DOUBLE AS eps, (c_nationkey * 3 - 10)::DOUBLE AS pe, c_nationkey / 4.0::DOUBLE - 1 AS payout_ratio FROM (SELECT DISTINCT user_id AS u FROM ev) LEFT JOIN customer ON c_custkey = u"""
        for f in families
    )
    return f"""WITH ev AS (SELECT event_id, user_id, ts::DATE AS d, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
bars AS MATERIALIZED ({union(0)}), dividends AS MATERIALIZED ({union(1)}), splits AS MATERIALIZED ({union(2)}), datasets AS MATERIALIZED ({datasets}),
lagged AS MATERIALIZED (SELECT *, lag(close) OVER s AS p_close, lag(t) OVER s AS p_t, lag(seq) OVER s AS p_seq, lead(close) OVER s AS n_close, lead(seq) OVER s AS n_seq, row_number() OVER (PARTITION BY dataset_id ORDER BY t, seq) - 1 AS rn FROM bars WINDOW s AS (PARTITION BY dataset_id ORDER BY seq)),
rets AS MATERIALIZED (SELECT *, CASE WHEN close > 0 AND p_close > 0 THEN close / p_close - 1 END AS ret FROM lagged),
lastbar AS MATERIALIZED (SELECT dataset_id, arg_max(ts_raw, rn) AS last_raw, arg_max(t, rn) AS last_t, arg_max(close, rn) FILTER (WHERE close > 0) AS close FROM rets GROUP BY dataset_id),
intime AS MATERIALIZED (SELECT dataset_id, t, rn, close, ts_raw, adj_factor, lag(close) OVER (PARTITION BY dataset_id ORDER BY rn) AS prev, max(rn) OVER (PARTITION BY dataset_id, t) AS lastrn FROM rets),
paid AS MATERIALIZED (SELECT d.*, b.rn AS idx, b.close AS ex_close, b.prev AS prev_close FROM dividends d ASOF LEFT JOIN (SELECT * FROM intime WHERE rn = lastrn) b ON d.dataset_id = b.dataset_id AND d.ex_t >= b.t)"""

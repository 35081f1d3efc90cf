"""Ingest: CSV, JSON and vendor payloads to the normalized tables; structural validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.functions import finite, normal_timestamp, to_ms
from tickvet.operators.tables import MarketTables
from tickvet.sources.csv_records import ALIASES, REQUIRED, read_csv_files

BAR = "struct<timestamp:string,open:double,high:double,low:double,close:double,volume:double,adjustmentFactor:double>"
DATASET = f"""struct<symbol:string,exchange:string,currency:string,source:string,identifiers:struct<isin:string,cusip:string,figi:string>,bars:array<{BAR}>,
dividends:array<struct<exDate:string,payDate:string,amount:double,currency:string,type:string>>,splits:array<struct<exDate:string,numerator:double,denominator:double>>,
fundamentals:struct<marketCap:double,sharesOutstanding:double,eps:double,pe:double,dividendYield:double,payoutRatio:double>>"""


class IngestError(ValueError):
    """The input is not a dataset."""


def _normalized(raw: DataFrame) -> MarketTables:
    """From rows (dataset_id, d: DATASET) to tables; seq is the place in the array."""
    fund = F.col("d.fundamentals")
    datasets = raw.select("dataset_id", "d.symbol", "d.source", "d.exchange", "d.currency", F.col("d.identifiers.isin").alias("isin"), fund["marketCap"].alias("market_cap"), fund["sharesOutstanding"].alias("shares_outstanding"), fund["eps"].alias("eps"), fund["pe"].alias("pe"), fund["dividendYield"].alias("dividend_yield"), fund["payoutRatio"].alias("payout_ratio"))
    b = raw.select("dataset_id", F.posexplode("d.bars").alias("seq", "x")).withColumn("ts_raw", normal_timestamp(F.col("x.timestamp")))
    bars = b.select("dataset_id", "seq", "ts_raw", to_ms(F.col("ts_raw")).alias("t"), "x.open", "x.high", "x.low", "x.close", "x.volume", F.col("x.adjustmentFactor").alias("adj_factor"))
    d = raw.select("dataset_id", F.posexplode("d.dividends").alias("seq", "x"))
    dividends = d.select("dataset_id", "seq", F.col("x.exDate").alias("ex_raw"), to_ms(F.col("x.exDate")).alias("ex_t"), F.col("x.payDate").alias("pay_raw"), to_ms(F.col("x.payDate")).alias("pay_t"), "x.amount", "x.currency", F.col("x.type").alias("div_type"))
    s = raw.select("dataset_id", F.posexplode("d.splits").alias("seq", "x"))
    splits = s.select("dataset_id", "seq", F.col("x.exDate").alias("ex_raw"), to_ms(F.col("x.exDate")).alias("ex_t"), "x.numerator", "x.denominator")
    return MarketTables(datasets, bars, dividends, splits)


def parse_json(files: DataFrame, symbol: str | None = None, source: str | None = None) -> MarketTables:
    """files: dataset_id, text. Each text is an object with `bars`, or a bare array of bars; the file's own names win over the options."""
    bare = F.ltrim("text").startswith("[")
    parsed = F.when(bare, F.to_json(F.struct(F.from_json("text", f"array<{BAR}>").alias("bars")))).otherwise(F.col("text"))
    d = F.from_json(parsed, DATASET)
    named = d.withField("symbol", F.coalesce(d["symbol"], F.lit(symbol), F.lit("UNKNOWN"))).withField("source", F.coalesce(d["source"], F.lit(source), F.lit("json")))
    return _normalized(files.select("dataset_id", named.alias("d")))


def bad_json(files: DataFrame) -> DataFrame:
    """dataset_id and error of the texts that are neither form."""
    bare = F.ltrim("text").startswith("[")
    ok = F.when(F.try_parse_json("text").isNull(), "invalid JSON").when(~bare & F.from_json("text", DATASET)["bars"].isNull(), "neither an object with bars nor an array of bars")
    return files.select("dataset_id", ok.alias("error")).filter("error IS NOT NULL")


def header_map(header: list[str]) -> dict[str, int]:
    """Place of each known column; raises IngestError naming what is missing and what was found."""
    names = [h.strip().lower() for h in header]
    found = {k: next((i for i, n in enumerate(names) if n in known), None) for k, known in ALIASES.items()}
    if missing := [k for k in REQUIRED if found[k] is None]:
        raise IngestError(f"missing columns: {', '.join(missing)}; found: {', '.join(names)}")
    return {k: i for k, i in found.items() if i is not None}


def read_csv(spark: SparkSession, path: str, symbol: str | None = None, source: str | None = None) -> MarketTables:
    """One CSV file with a header to one dataset (its id is the path); csv_records reads many."""
    tables, errors = read_csv_files(spark, path, F.lit(symbol), source or "csv", F.lit(path))
    if bad := errors.first():
        raise IngestError(bad.error)
    if tables.datasets.isEmpty():
        raise IngestError("the file has no header")
    return tables


def read_json(spark: SparkSession, path: str, symbol: str | None = None, source: str | None = None) -> MarketTables:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("dataset_id"), F.col("value").alias("text"))
    if bad := bad_json(files).first():
        raise IngestError(f"{bad.dataset_id}: {bad.error}")
    return parse_json(files, symbol, source)


def read_file(spark: SparkSession, path: str, symbol: str | None = None, source: str | None = None) -> MarketTables:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json"):
        raise IngestError(f"unknown file type: .{kind}")
    return (read_csv if kind == "csv" else read_json)(spark, path, symbol, source)


CHART = """struct<chart:struct<result:array<struct<meta:struct<symbol:string,currency:string,exchangeName:string,gmtoffset:bigint>,timestamp:array<bigint>,
indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>,
events:struct<dividends:map<string,struct<date:bigint,amount:double>>,splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>>>,error:struct<code:string,description:string>>>"""


def parse_chart(payloads: DataFrame) -> MarketTables:
    """payloads: dataset_id, text (columnar chart JSON). Days are the exchange's local ones; bars with a missing price are skipped."""
    r = payloads.select("dataset_id", F.get(F.from_json("text", CHART)["chart"]["result"], 0).alias("r"))
    day = lambda e: F.date_format(F.timestamp_seconds(e + F.coalesce(F.col("r.meta.gmtoffset"), F.lit(0))), "yyyy-MM-dd")
    q = F.get(F.col("r.indicators.quote"), 0)
    adj = F.get(F.col("r.indicators.adjclose"), 0)["adjclose"]

    def bar(t, i):
        at = lambda c: F.get(q[c], i)
        close = at("close")
        return F.struct(day(t).alias("timestamp"), at("open").alias("open"), at("high").alias("high"), at("low").alias("low"), close.alias("close"), at("volume").alias("volume"), F.when(close > 0, F.try_divide(F.get(adj, i), close)).alias("adjustmentFactor"))

    bars = F.filter(F.transform(F.coalesce("r.timestamp", F.array().cast("array<bigint>")), bar), lambda b: b["open"].isNotNull() & b["high"].isNotNull() & b["low"].isNotNull() & b["close"].isNotNull())
    dividends = F.transform(F.array_sort(F.map_values("r.events.dividends")), lambda e: F.struct(day(e["date"]).alias("exDate"), F.lit(None).cast("string").alias("payDate"), e["amount"].alias("amount"), F.col("r.meta.currency").alias("currency"), F.lit(None).cast("string").alias("type")))
    splits = F.transform(F.array_sort(F.map_values("r.events.splits")), lambda e: F.struct(day(e["date"]).alias("exDate"), e["numerator"].alias("numerator"), e["denominator"].alias("denominator")))
    null = lambda t: F.lit(None).cast(t)
    d = F.struct(F.col("r.meta.symbol").alias("symbol"), F.col("r.meta.exchangeName").alias("exchange"), F.col("r.meta.currency").alias("currency"), F.lit("yahoo").alias("source"), null("struct<isin:string,cusip:string,figi:string>").alias("identifiers"), bars.alias("bars"), dividends.alias("dividends"), splits.alias("splits"), null("struct<marketCap:double,sharesOutstanding:double,eps:double,pe:double,dividendYield:double,payoutRatio:double>").alias("fundamentals"))
    return _normalized(r.filter("r IS NOT NULL").select("dataset_id", d.alias("d")))


def chart_errors(payloads: DataFrame) -> DataFrame:
    c = F.from_json("text", CHART)["chart"]
    text = F.when(c.isNull(), "not a chart").when(c["error"]["code"].isNotNull(), F.concat_ws(": ", c["error"]["code"], c["error"]["description"])).when(F.coalesce(F.size(c["result"]), F.lit(0)) < 1, "no result")
    return payloads.select("dataset_id", text.alias("error")).filter("error IS NOT NULL")


def parse_daily_series(payloads: DataFrame, symbol: str = "UNKNOWN") -> MarketTables:
    """payloads: dataset_id, text: an object of days with numbers as strings, ascending by day after parsing."""
    series = F.from_json("text", "struct<`Time Series (Daily)`:map<string,map<string,string>>>")["Time Series (Daily)"]
    num = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("double")
    rows = payloads.select("dataset_id", F.transform(F.array_sort(F.map_keys(series)), lambda k: F.struct(k.alias("key"), F.try_element_at(series, k).alias("value"))).alias("e"))

    def bar(e):
        m = e["value"]
        close = num(m, "4. close")
        return F.struct(e["key"].alias("timestamp"), num(m, "1. open").alias("open"), num(m, "2. high").alias("high"), num(m, "3. low").alias("low"), close.alias("close"), num(m, "6. volume").alias("volume"), F.when(close > 0, F.try_divide(num(m, "5. adjusted close"), close)).alias("adjustmentFactor"))

    bars = F.filter(F.transform("e", bar), lambda b: finite(b["close"]) & (b["close"] > 0))
    paid = F.filter("e", lambda e: num(e["value"], "7. dividend amount") > 0)
    cut = F.filter("e", lambda e: (num(e["value"], "8. split coefficient") > 0) & (num(e["value"], "8. split coefficient") != 1))
    null = lambda t: F.lit(None).cast(t)
    dividends = F.transform(paid, lambda e: F.struct(e["key"].alias("exDate"), null("string").alias("payDate"), num(e["value"], "7. dividend amount").alias("amount"), null("string").alias("currency"), null("string").alias("type")))
    splits = F.transform(cut, lambda e: F.struct(e["key"].alias("exDate"), num(e["value"], "8. split coefficient").alias("numerator"), F.lit(1.0).alias("denominator")))
    d = F.struct(F.lit(symbol).alias("symbol"), null("string").alias("exchange"), null("string").alias("currency"), F.lit("alphavantage").alias("source"), null("struct<isin:string,cusip:string,figi:string>").alias("identifiers"), bars.alias("bars"), dividends.alias("dividends"), splits.alias("splits"), null("struct<marketCap:double,sharesOutstanding:double,eps:double,pe:double,dividendYield:double,payoutRatio:double>").alias("fundamentals"))
    return _normalized(rows.filter("e IS NOT NULL").select("dataset_id", d.alias("d")))


def daily_series_errors(payloads: DataFrame) -> DataFrame:
    """dataset_id and error of the payloads that are the vendor's messages, or hold no series."""
    keys = ("Error Message", "Note", "Information")  # fixed values of the vendor
    d = F.from_json("text", ", ".join(f"`{k}` string" for k in keys) + ", `Time Series (Daily)` map<string,map<string,string>>")
    told = F.coalesce(*(F.when(F.length(d[k]) > 0, F.concat(F.lit(f"{k}: "), d[k])) for k in keys))
    error = F.coalesce(told, F.when(F.try_parse_json("text").isNull(), "not a JSON object"), F.when(d["Time Series (Daily)"].isNull(), "no daily series"))
    return payloads.select("dataset_id", error.alias("error")).filter("error IS NOT NULL")


def schema_findings(t: MarketTables, most: int = 20) -> DataFrame:
    """SCHEMA_INVALID findings of structural faults: critical, at most `most` a dataset, not collapsed; the first counts them all."""

    def faults(df: DataFrame, table: str, checks: dict[str, Column], seq: Column) -> DataFrame:
        found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())
        return df.select("dataset_id", F.lit(table).alias("table"), seq.alias("seq"), F.posexplode(found).alias("i", "field")).withColumn("path", F.concat_ws(".", F.when(F.col("seq") >= 0, F.concat(F.col("table"), F.lit("."), F.col("seq").cast("string"))), "field"))

    c, currency = F.col, r"^[A-Z]{3}$"
    parts = [
        faults(t.datasets, "", {"symbol": F.coalesce(F.length("symbol"), F.lit(0)) == 0, "source": F.coalesce(F.length("source"), F.lit(0)) == 0, "currency": F.coalesce(~c("currency").rlike(currency), F.lit(False))}, F.lit(-1)),
        faults(t.bars, "bars", {"timestamp": c("t").isNull(), **{x: ~finite(c(x)) for x in ("open", "high", "low", "close")}, "adjustmentFactor": c("adj_factor").isNotNull() & ~(finite(c("adj_factor")) & (c("adj_factor") > 0))}, c("seq")),
        faults(t.dividends, "dividends", {"exDate": c("ex_t").isNull(), "payDate": c("pay_raw").isNotNull() & c("pay_t").isNull(), "amount": ~finite(c("amount")), "currency": F.coalesce(~c("currency").rlike(currency), F.lit(False)), "type": F.coalesce(~c("div_type").isin("regular", "special"), F.lit(False))}, c("seq")),
        faults(t.splits, "splits", {"exDate": c("ex_t").isNull(), "numerator": ~(finite(c("numerator")) & (c("numerator") > 0)), "denominator": ~(finite(c("denominator")) & (c("denominator") > 0))}, c("seq")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    from pyspark.sql import Window

    w = Window.partitionBy("dataset_id").orderBy("table", "seq", "i")
    ranked = out.select("dataset_id", "path", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("dataset_id")).alias("n")).filter(c("r") <= most)
    return ranked.select("dataset_id", F.lit("SCHEMA_INVALID").alias("rule"), F.lit("critical").alias("severity"), F.lit(None).cast("string").alias("where_date"), F.lit(None).cast("double").alias("value"), F.to_json(F.struct("path")).alias("evidence"), F.when((c("r") == 1) & (c("n") > most), c("n")).otherwise(1).cast("long").alias("occurrences"), F.lit("block").alias("action"), F.lit("validity").alias("dimension"), F.concat(F.lit("structure not valid at "), "path").alias("explanation"), F.lit(0).alias("severity_rank"), c("r").cast("int").alias("rule_rank"))

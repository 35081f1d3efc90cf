"""CSV files made of the table events, in five forms, two of which can't be read; and the DuckDB SQL of what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.operators.tables import MarketTables
from tickvet.shared import fresh_path
from tickvet.sources.csv_records import read_csv_files

#: Headers by the file's number modulo 5.
HEADERS = ("date,open,high,low,close,volume", '"Time" ,O,H,L,C,Vol', "note,datetime,open,high,low,close,v", "date,open,high,low", "date,open,high,low,close")
_RECORDS = (
    "concat_ws(',', d, o, h, l, c, v)", "concat_ws(',', date_format(d, 'yyyyMMdd'), concat('\"', o, '\"'), h, l, c, v)",
    "concat_ws(',', concat('\"say \"\"', k, '\"\", then\n\n', d, ',', o, '\"'), d, o, h, l, c, v)", "concat_ws(',', d, o, h, l)", "CASE WHEN k % 3 = 0 THEN concat_ws(',', d, o, h, l) ELSE concat_ws(',', d, o, h, l, c) END",
)
BY_FILE = 10  # users


def write_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of one file for every ten users, a bar for each of their events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value")
    e = e.select(F.floor(F.col("user_id") / BY_FILE).cast("long").alias("file"), "event_id", F.to_date("ts").alias("d"), F.get_json_object("props", "$.k").cast("int").alias("k"), value.alias("o"), (value + 2).alias("h"), (value - 5).alias("l"), (value - 1).alias("c"))
    e = e.withColumn("v", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("k").cast("string")))
    pick = lambda xs: F.element_at(F.array(*xs), (F.col("file") % 5 + 1).cast("int"))
    body = e.select("file", F.col("event_id").alias("place"), pick(map(F.expr, _RECORDS)).alias("value"))
    head = e.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), pick(map(F.lit, HEADERS)).alias("value"))
    path = fresh_path(spark)
    body.withColumn("place", F.col("place").cast("long")).unionByName(head).repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    return path


def _read(spark: SparkSession, sf_dir: str) -> tuple[MarketTables, DataFrame]:
    return read_csv_files(spark, write_files(spark, sf_dir), dataset_id=F.regexp_extract("file", r"/file=(\d+)/", 1))


def csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all files that can be read."""
    return _read(spark, sf_dir)[0].bars.select("dataset_id", "seq", "ts_raw", *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file its bars, or why it can't be read."""
    tables, errors = _read(spark, sf_dir)
    counts = tables.bars.groupBy("dataset_id").agg(F.count("*").alias("bars"))
    good = tables.datasets.select("dataset_id").join(counts, "dataset_id", "left").select("dataset_id", F.coalesce("bars", F.lit(0)).alias("bars"), F.lit("").alias("error"))
    return good.unionByName(errors.select("dataset_id", F.lit(0).cast("long").alias("bars"), "error"))


_EVENTS = f"""WITH e AS (SELECT user_id // {BY_FILE} AS file, event_id, strftime(ts, '%Y-%m-%d') AS d, CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY event_id))::INT AS n FROM e),
ragged AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE k % 3 = 0) AS bad, array_to_string(list_sort(list(n) FILTER (WHERE k % 3 = 0))[1:3], ', ') AS first FROM numbered WHERE file % 5 = 4 GROUP BY file),
state AS (SELECT file, CASE WHEN file % 5 = 3 THEN 'missing columns: close; found: date, open, high, low' WHEN bad * 10 > total THEN bad || ' of ' || total || ' rows have a different number of fields, first rows ' || first ELSE '' END AS error FROM (SELECT DISTINCT file FROM e) LEFT JOIN ragged USING (file))"""
BARS_SQL = f"""{_EVENTS} SELECT file::VARCHAR AS dataset_id, n - 1 AS seq, d AS ts_raw, round(value, 6) AS open, round(value + 2, 6) AS high, round(value - 5, 6) AS low,
CASE WHEN file % 5 <> 4 OR k % 3 <> 0 THEN round(value - 1, 6) END AS close, CASE WHEN file % 5 < 3 AND k % 4 <> 0 THEN k::DOUBLE END AS volume FROM numbered JOIN state USING (file) WHERE error = ''"""
FILES_SQL = f"{_EVENTS} SELECT file::VARCHAR AS dataset_id, CASE WHEN error = '' THEN count(*) ELSE 0 END AS bars, error FROM e JOIN state USING (file) GROUP BY file, error"

"""The history store: one directory a symbol, append-only JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "at string, symbol string, source string, sanity_score int, summary struct<critical:bigint,warning:bigint,info:bigint>, rules array<string>, corrupt string"


def symbol_key(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "[^A-Z0-9._-]", "_")


def append(entries: DataFrame, path: str) -> None:
    entries.withColumn("symbol_key", symbol_key(F.col("symbol"))).write.mode("append").partitionBy("symbol_key").json(path)


def read(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest `limit` entries of each symbol; lines that are no entries are skipped, missing parts get defaults."""
    raw = spark.read.schema(ENTRY + ", symbol_key string").option("columnNameOfCorruptRecord", "corrupt").json(path)
    good = raw.filter("corrupt IS NULL AND at IS NOT NULL AND sanity_score IS NOT NULL")
    zero = F.struct(*(F.coalesce(F.col(f"summary.{s}"), F.lit(0)).alias(s) for s in ("critical", "warning", "info")))
    full = good.select("at", F.coalesce("symbol", "symbol_key").alias("symbol"), F.coalesce("source", F.lit("unknown")).alias("source"), "sanity_score", zero.alias("summary"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), "symbol_key")
    return full.withColumn("r", F.row_number().over(Window.partitionBy("symbol_key").orderBy(F.desc("at")))).filter(F.col("r") <= limit).drop("r")


def trend(entries: DataFrame, step: int = 3) -> DataFrame:
    """symbol_key, change (newest - oldest score) and whether that is improving, degrading or stable."""
    out = entries.groupBy("symbol_key").agg(F.count("*").alias("entries"), (F.max_by("sanity_score", "at") - F.min_by("sanity_score", "at")).alias("change"))
    return out.withColumn("trend", F.when(F.col("change") > step, "improving").when(F.col("change") < -step, "degrading").otherwise("stable"))

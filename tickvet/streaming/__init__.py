"""Checks over streams: daily bars from ticks, and row-local rules on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.rules import ohlc_inconsistent, price_nonpositive, row_occurrences, volume_negative, zero_volume_moved
from tickvet.operators.tables import MarketTables

ROW_LOCAL = {"PRICE_NONPOSITIVE": price_nonpositive, "OHLC_INCONSISTENT": ohlc_inconsistent, "VOLUME_NEGATIVE": volume_negative, "ZERO_VOLUME_MOVED": zero_volume_moved}


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """ticks: dataset_id, ts, seq, price, to one bar a day and dataset; late ticks count until the watermark passes."""
    day = F.window("ts", "1 day")
    out = ticks.withWatermark("ts", delay).groupBy(day.alias("w"), "dataset_id").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("dataset_id", F.date_format("w.start", "yyyy-MM-dd").alias("ts_raw"), "open", "high", "low", "close", "volume")


def row_local_occurrences(bars: DataFrame) -> DataFrame:
    """Occurrences of the rules that look at one bar only; bars may be a stream."""
    return row_occurrences(MarketTables(None, bars, None, None), "bars", [(check, CHECK_RULES[r].params) for r, check in ROW_LOCAL.items()])

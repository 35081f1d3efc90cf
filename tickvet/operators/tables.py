"""The normalized tables of many datasets, and what the rules share: one enriched bars table and one as-of pass.

All windows over bars are partitioned by dataset_id alone, so they share one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvet.functions import finite, positive
from tickvet.shared import NARROW, discard, written

# dataset_id string, symbol, source, exchange, currency, isin strings; numbers of the fundamentals
DATASETS = "dataset_id string, symbol string, source string, exchange string, currency string, isin string, market_cap double, shares_outstanding double, eps double, pe double, dividend_yield double, payout_ratio double"
# seq: place in the input; ts_raw: the time as given; t: its epoch milliseconds, null if unparseable
BARS = "dataset_id string, seq int, ts_raw string, t long, open double, high double, low double, close double, volume double, adj_factor double"
DIVIDENDS = "dataset_id string, seq int, ex_raw string, ex_t long, pay_raw string, pay_t long, amount double, currency string, div_type string"
SPLITS = "dataset_id string, seq int, ex_raw string, ex_t long, numerator double, denominator double"


def by_seq():
    return Window.partitionBy("dataset_id").orderBy("seq")


def by_time():
    return Window.partitionBy("dataset_id").orderBy(F.col("t").asc_nulls_last(), "seq")


def whole():
    return Window.partitionBy("dataset_id")


def as_of(events: DataFrame, bars: DataFrame, event_time: str = "ex_t") -> DataFrame:
    """events with the last bar at or before each (struct `bar`, null if none): a union and one running window.

    bars: columns dataset_id, t, rn (place in time order) and any others; bars without time match nothing.
    """
    names = [c for c in bars.columns if c not in ("dataset_id", "t")]
    event_type = F.struct(*events.columns)
    left = bars.filter("t IS NOT NULL").select("dataset_id", "t", F.lit(0).alias("is_event"), F.col("rn").cast("long").alias("ord"), F.struct(*names).alias("bar"))
    right = events.filter(F.col(event_time).isNotNull()).select("dataset_id", F.col(event_time).alias("t"), F.lit(1).alias("is_event"), F.col("seq").cast("long").alias("ord"), event_type.alias("event"))
    both = left.unionByName(right, allowMissingColumns=True)
    running = Window.partitionBy("dataset_id").orderBy("t", "is_event", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bar", F.last("bar", ignorenulls=True).over(running)).filter("is_event = 1").select("event.*", "bar")


@dataclass
class MarketTables:
    datasets: DataFrame
    bars: DataFrame
    dividends: DataFrame
    splits: DataFrame
    cache: bool = False  # write the tables that rules share, once
    _shared: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._shared:
            self._shared[name] = written(make(), NARROW) if self.cache else make()
        return self._shared[name]

    def written(self, bars: bool = True) -> MarketTables:
        """These tables, computed once; so will be those that the rules share. bars: whether the bars are read as such, not only through enriched."""
        if self.cache:
            return self
        return MarketTables(written(self.datasets, NARROW), written(self.bars, NARROW) if bars else self.bars, written(self.dividends, NARROW), written(self.splits, NARROW), cache=True)

    def release(self) -> None:
        """Delete what was written of these tables, once nothing reads it."""
        if self.cache:
            discard(*(x for x in (self.datasets, self.bars, self.dividends, self.splits, *self._shared.values()) if hasattr(x, "_written_at")))
            self._shared.clear()

    @property
    def enriched(self) -> DataFrame:
        """Bars with neighbours, returns, the profile's median and MAD, and place in time order (rn from 0)."""

        def make():
            b = self.bars.withColumns({
                "p_close": F.lag("close").over(by_seq()), "p_volume": F.lag("volume").over(by_seq()), "p_t": F.lag("t").over(by_seq()), "p_raw": F.lag("ts_raw").over(by_seq()),
                "p_seq": F.lag("seq").over(by_seq()), "n_close": F.lead("close").over(by_seq()), "n_seq": F.lead("seq").over(by_seq()),
                "rn": F.row_number().over(by_time()) - 1, "bars": F.count("*").over(whole()),
            })
            both = (F.col("close") > 0) & (F.col("p_close") > 0) & ~F.isnan("close") & ~F.isnan("p_close")
            b = b.withColumn("ret", F.when(both, F.try_divide(F.col("close"), F.col("p_close")) - 1))
            b = b.withColumns({"ret_median": F.median("ret").over(whole()), "ret_count": F.count("ret").over(whole())})
            return b.withColumn("ret_mad", F.median(F.abs(F.col("ret") - F.col("ret_median"))).over(whole()))

        return self._once("enriched", make)

    @property
    def stats(self) -> DataFrame:
        """Of each dataset with bars: their number, median finite close, the last bar's raw time and time, and the latest finite positive close."""

        def make():
            good = F.when(positive(F.col("close")), F.struct("rn", "close"))
            known = F.when(finite(F.col("close")), F.col("close"))
            found = self.enriched.groupBy("dataset_id").agg(F.count("*").alias("n"), F.median(known).alias("median_close"), F.max(F.struct("rn", "ts_raw", "t")).alias("l"), F.max(good).alias("c"))
            return found.select("dataset_id", "n", "median_close", F.col("l.ts_raw").alias("last_raw"), F.col("l.t").alias("last_t"), F.col("c.close").alias("close"))

        return self._once("stats", make)

    @property
    def last(self) -> DataFrame:
        return self.stats.select("dataset_id", "last_raw", "last_t", "close")

    @property
    def facts(self) -> DataFrame:
        """All datasets with their stats; n is 0 where there are no bars."""
        return self.datasets.join(self.stats, "dataset_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    @property
    def paid(self) -> DataFrame:
        """Dividends with the bar as of the ex-date (idx, ex_close) and the close before it (prev_close)."""

        def make():
            bars = self.enriched.select("dataset_id", "t", "rn", "close", F.lag("close").over(by_time()).alias("prev"))
            return as_of(self.dividends, bars).select(*self.dividends.columns, F.col("bar.rn").alias("idx"), F.col("bar.close").alias("ex_close"), F.col("bar.prev").alias("prev_close"))

        return self._once("paid", make)

    @property
    def factored(self) -> DataFrame:
        """Bars with a finite adjustment factor."""
        return self.enriched.filter(finite(F.col("adj_factor")))

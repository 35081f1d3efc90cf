"""What a report page draws, as tables: marks by date, the bars of ex-dates, and where two sources part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvet.functions import finite
from tickvet.operators.tables import as_of


def marks_by_date(findings: DataFrame) -> DataFrame:
    """(dataset_id, where_date, severity, rule) of the worst finding of each date; of equal severities the first by rule."""
    worst = F.min_by(F.struct("severity", "rule"), F.struct("severity_rank", "rule_rank"))
    return findings.filter("where_date IS NOT NULL").groupBy("dataset_id", "where_date").agg(worst.alias("w")).select("dataset_id", "where_date", "w.*")


def first_bar_on_or_after(events: DataFrame, bars: DataFrame, event_time: str = "ex_t") -> DataFrame:
    """events with the first bar at or after each (struct `bar`, null if none): as_of() with time turned round."""
    back = bars.withColumns({"t": -F.col("t"), "rn": -F.col("rn")})
    turned = events.withColumn("back_t", -F.col(event_time))
    return as_of(turned, back, "back_t").drop("back_t").withColumn("bar", F.col("bar").withField("rn", -F.col("bar.rn")))


def divergences(aligned: DataFrame, most: float = 0.02) -> DataFrame:
    """(dataset_id, day, a_close, b_close, gap) of the shared days on which closes differ by more than most of the larger one."""
    larger = F.greatest("a_close", "b_close")
    gap = F.when(larger > 0, F.abs(F.col("a_close") - F.col("b_close")) / larger)
    return aligned.select("dataset_id", "day", "a_close", "b_close", gap.alias("gap")).filter(F.col("gap") > most)


def thinned(rows: DataFrame, order: list[str], of: list[str], most: int = 600) -> DataFrame:
    """Of each dataset the `most` rows that lie evenly over its order, first and last among them, or all if it has no more.

    Point i of most is the row at round(i * (n - 1) / (most - 1)), halves upwards, in whole numbers. Added are point, n, and
    low and high: the least and greatest finite value of the columns `of` over all rows, so that a chart's scale is that of
    the whole series. A dataset's rows are ordered in one task, as those of the windows by dataset are.
    """
    if most < 2:
        raise ValueError("a series is thinned to its two ends at least")
    mine = Window.partitionBy("dataset_id")
    numbers = [F.when(finite(F.col(c)), F.col(c)) for c in of]
    one = lambda pick, xs: pick(*xs) if len(xs) > 1 else xs[0]
    out = rows.withColumns({"place": (F.row_number().over(mine.orderBy(*order)) - 1).cast("long"), "n": F.count("*").over(mine), "low": F.min(one(F.least, numbers)).over(mine), "high": F.max(one(F.greatest, numbers)).over(mine)})
    # The first point that reaches the row, and the row which that point takes.
    last, parts = F.col("n") - 1, most - 1
    reach = F.expr(f"(greatest((2 * place - 1) * {parts}, 0) + 2 * (n - 1) - 1) div (2 * (n - 1))")
    point = F.when(F.col("n") <= most, F.col("place")).otherwise(reach)
    out = out.withColumn("point", point)
    takes = F.expr(f"(2 * point * (n - 1) + {parts}) div {2 * parts}")
    return out.filter((last < most) | ((F.col("point") <= parts) & (takes == F.col("place")))).drop("place")

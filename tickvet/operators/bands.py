"""Joins of rows whose numbers lie within a band of each other, by buckets.

A band alone is no equi key: joined on the dataset only, each row meets all rows of its dataset. Here a bucket as wide as
the band is a second key. A left row has one bucket and a right row is sent to the one or two that its band touches, so each pair
meets once, outer and anti joins keep their meaning, and the work is in proportion to the pairs in the band. A large dataset
is dealt to many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: dict[str, str], at: str, to: str, low: float, high: float, on: Column | None = None, how: str = "inner") -> DataFrame:
    """left joined with the rows of right whose `to` is from at + low up to at + high, and for which `on` holds.

    keys: columns of left and those of right that they equal. Columns of left and right have no name in common. Rows without a number (or key)
    meet nothing; they stay in outer and anti joins.
    """
    low, high = math.floor(low), math.ceil(high)
    size = max(high - low, 1)
    bucket = lambda x: F.floor(x / size)
    mine = left.withColumn("band_left", bucket(F.col(at)))
    first, last = bucket(F.col(to) - high), bucket(F.col(to) - low)
    theirs = right.filter(F.col(to).isNotNull()).withColumn("band_right", F.explode(F.sequence(first, last)))
    meets = (F.col("band_left") == F.col("band_right")) & (F.col(to) - F.col(at)).between(low, high)
    for a, b in keys.items():
        meets &= F.col(a) == F.col(b)
    return mine.join(theirs, meets & on if on is not None else meets, how).drop("band_left", "band_right")

"""Rules that look at one bar, over a stream: the findings of a replayed stream equal the batch ones."""

from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.rules import CHECKS
from tickvet.operators.tables import BARS, MarketTables
from tickvet.streaming import ROW_LOCAL, row_local_occurrences

ROWS = [
    ("d", 0, "2024-01-02", 0, 1.0, 2.0, 0.5, 1.5, 10.0, None),
    ("d", 1, "2024-01-03", 1, -1.0, 0.5, 2.0, 1.5, -4.0, None),  # open not positive, high below low, both outside, volume negative
    ("d", 2, "2024-01-04", 2, 1.0, 2.0, 0.5, 1.5, 0.0, None),  # moved without volume
    ("e", 0, None, None, None, float("nan"), 1.0, 1.0, None, None),
    ("e", 1, "2024-01-02", 0, 1.0, 1.0, 1.0, 1.0, float("nan"), None),
]


def found(df):
    return sorted((r.dataset_id, r.rule, r.k1, r.k2, r.severity, str(r.where_date), str(r.value), r.evidence) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    spark.createDataFrame(ROWS, BARS).repartition(3).write.parquet(path)
    stream = row_local_occurrences(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("row_local").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination(120)
    bars = spark.createDataFrame(ROWS, BARS)
    alone = [x for r in ROW_LOCAL for x in found(CHECKS[r](MarketTables(None, bars, None, None), CHECK_RULES[r].params))]
    got = found(spark.table("row_local"))
    assert got == sorted(alone) == found(row_local_occurrences(bars))
    assert {(x[1], x[2]) for x in got if x[0] == "d"} == {("PRICE_NONPOSITIVE", 1), ("OHLC_INCONSISTENT", 1), ("VOLUME_NEGATIVE", 1), ("ZERO_VOLUME_MOVED", 2)}

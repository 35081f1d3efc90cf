"""The derived bars replayed as a stream, and the DuckDB SQL of what the batch rules find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.functions.numbers import scaled
from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.tables import BARS
from tickvet.plans.derived import ctes, tables
from tickvet.plans.oracles import CHECK_SQL
from tickvet.shared import fresh_path
from tickvet.streaming.neighbours import NEIGHBOUR, neighbour_occurrences, settled

BATCHES = 4


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars dealt to micro-batches without regard to their order, each dataset's to all of them; occurrences of the rules of neighbours."""
    t = tables(spark, sf_dir)
    source, sink, state = fresh_path(spark), fresh_path(spark), fresh_path(spark)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES)  # of a micro-batch
    t.bars.repartition(BATCHES * files, F.xxhash64("dataset_id", "seq")).write.parquet(source)
    bars = spark.readStream.schema(BARS).option("maxFilesPerTrigger", files).parquet(source)
    told = neighbour_occurrences(bars, t.splits)
    told.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = settled(spark.read.schema(told.schema).parquet(sink))
    return found.select("rule", "dataset_id", "k1", "k2", "severity", "where_date", scaled("value", 6).alias("value"))


_cols = "(dataset_id, k1, k2, severity, where_date, value)"
_union = " UNION ALL ".join(f"SELECT '{r}' AS rule, * FROM ({CHECK_SQL[r].format(sev=chr(39) + CHECK_RULES[r].severity + chr(39))}) AS o{_cols}" for r in NEIGHBOUR)
STREAM_SQL = f"{ctes('ue')} SELECT rule, dataset_id, k1::BIGINT AS k1, k2::BIGINT AS k2, severity, where_date, round(value::DOUBLE, 6) AS value FROM ({_union})"

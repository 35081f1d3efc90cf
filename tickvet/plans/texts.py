"""Dataset texts made of the table events, with faults of structure, and the DuckDB SQL of their issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.sources import structure

#: A text for each event, of its k and whole value v; the same words in Spark and DuckDB.
TEXT = """concat('{', CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN '"symbol":5,' ELSE concat('"symbol":"S', k, '",') END,
CASE WHEN k % 5 = 0 THEN '"source":"feed","currency":"usd",' ELSE '"source":"feed","currency":"USD",' END,
'"bars":[{"timestamp":"2024-01-02","open":', v, ',"high":', v, ',"low":', v, ',"close":', CASE WHEN k % 3 = 0 THEN concat('"', v, '"') ELSE concat('', v) END,
CASE WHEN k % 13 = 0 THEN ',"volume":null' ELSE '' END, CASE WHEN k % 4 = 0 THEN ',"adjustmentFactor":-1' ELSE '' END, '}', CASE WHEN k % 17 = 0 THEN ',"x"' ELSE '' END, ']',
CASE WHEN k % 6 = 0 THEN ',"dividends":[{"exDate":"2024-01-05","amount":1,"type":"extra"}]' ELSE '' END, CASE WHEN k % 19 = 0 THEN '' ELSE '}' END)"""


def dataset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_id, text: a dataset for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor("value").cast("long").alias("v"))
    return e.select(F.col("event_id").alias("dataset_id"), F.expr(TEXT).alias("text"))


def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.issues(dataset_texts(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each path and code: datasets and findings."""
    found = structure.findings(structure.issues(dataset_texts(spark, sf_dir)))
    return found.groupBy(F.get_json_object("evidence", "$.path").alias("path"), F.get_json_object("evidence", "$.code").alias("code"), "severity", "action").agg(F.count("*").alias("findings"), F.countDistinct("dataset_id").alias("datasets"))


_ISSUES = f"""WITH texts AS (SELECT event_id AS dataset_id, {TEXT} AS text FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events)),
valid AS (SELECT * FROM texts WHERE json_valid(text)),
elements AS (SELECT dataset_id, i, json_extract(text, '$.bars[' || i || ']') AS x FROM (SELECT dataset_id, text, unnest(generate_series(0, json_array_length(text, '$.bars')::INT - 1)) AS i FROM valid)),
found AS (SELECT dataset_id, 0 AS part, -3 AS i, -1 AS f, '(root)' AS path, 'json' AS code, 'object' AS expected, 'text' AS received FROM texts WHERE NOT json_valid(text)
UNION ALL SELECT dataset_id, 0, -1, 0, 'symbol', CASE WHEN json_type(text, '$.symbol') IS NULL THEN 'missing' ELSE 'type' END, 'string', CASE WHEN json_type(text, '$.symbol') IS NULL THEN 'missing' ELSE 'number' END FROM valid WHERE coalesce(json_type(text, '$.symbol'), '') <> 'VARCHAR'
UNION ALL SELECT dataset_id, 0, -1, 2, 'currency', 'format', 'three capital letters', json_extract_string(text, '$.currency') FROM valid WHERE NOT regexp_full_match(json_extract_string(text, '$.currency'), '[A-Z]{{3}}')
UNION ALL SELECT dataset_id, 2, i, -1, 'bars.' || i, 'type', 'object', 'string' FROM elements WHERE json_type(x) = 'VARCHAR'
UNION ALL SELECT dataset_id, 2, i, 4, 'bars.' || i || '.close', 'type', 'number', 'string' FROM elements WHERE json_type(x, '$.close') = 'VARCHAR'
UNION ALL SELECT dataset_id, 2, i, 5, 'bars.' || i || '.volume', 'type', 'number', 'null' FROM elements WHERE json_type(x, '$.volume') = 'NULL'
UNION ALL SELECT dataset_id, 2, i, 6, 'bars.' || i || '.adjustmentFactor', 'range', 'above 0', CAST(CAST(json_extract(x, '$.adjustmentFactor') AS DOUBLE) AS VARCHAR) FROM elements WHERE json_type(x) = 'OBJECT' AND CAST(json_extract(x, '$.adjustmentFactor') AS DOUBLE) <= 0
UNION ALL SELECT dataset_id, 3, 0, 4, 'dividends.0.type', 'enum', 'regular or special', json_extract_string(text, '$.dividends[0].type') FROM valid WHERE json_extract_string(text, '$.dividends[0].type') NOT IN ('regular', 'special'))"""
ISSUES_SQL = f"{_ISSUES} SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY part, i, f) - 1 AS place, path, code, expected, received FROM found"
FINDINGS_SQL = f"{_ISSUES} SELECT path, code, 'critical' AS severity, 'block' AS action, count(*) AS findings, count(DISTINCT dataset_id) AS datasets FROM found GROUP BY path, code"

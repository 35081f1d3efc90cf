"""Values at a tie of their last digit, against the SQL."""

import datetime

import duckdb

from tickvet.functions.numbers import scaled
from tickvet.plans.queries import QUERIES, SQL


def test_rounds_as_the_sql(spark):
    xs = [32.3 / 64.0, -32.3 / 64.0, 4.1 / 64.0, 9.0 / 25.6, 0.0, 1.0, 123.456789, 4.9999999e-7, 5e-7, 1e18, -1e300, float("inf"), None]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(scaled("x", 6).alias("y")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs] and got[0] == 0.504687


def test_dividend_yield_at_a_tie(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, at, 2, "purchase", 3230.0, '{"k": 5}'), (2, at + datetime.timedelta(days=1), 2, "view", 64.0, '{"k": 50}')]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, 1, 5.0, "X")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["r_div_yield_impossible"](spark, str(tmp_path)).collect()]
    assert got == con.execute(SQL["r_div_yield_impossible"]).fetchall() and [r[-1] for r in got] == [0.504687]

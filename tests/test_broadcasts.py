"""Tables of the engine grow with the datasets: none goes through the driver, however small its file."""

from tickvet.operators import engine, tables
from tickvet.plans import derived
from tickvet.plans.queries import CONFIG
from tickvet.shared import held, written


def test_no_table_is_broadcast(spark, monkeypatch):
    plans = []

    def spied(df, settings=None):
        with held(spark, settings or {}):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, settings)

    monkeypatch.setattr(engine, "written", spied)
    monkeypatch.setattr(tables, "written", spied)
    reports, _ = engine.check(derived.tables(spark, "/root/testdata/sf0.001"), CONFIG)
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert "BroadcastHashJoin" not in reports._jdf.queryExecution().executedPlan().toString()

import json

import pytest
from pyspark.sql import functions as F

from tickvet import functions as tf
from tickvet.operators import config, engine, report_html
from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.compare import PairTables, compare
from tickvet.operators.rules import CHECKS
from tickvet.operators.tables import MarketTables
from tickvet.shared import held
from tickvet.sources import IngestError, bad_json, header_map, history, parse_chart, parse_daily_series, parse_json, read_file, schema_findings


def dataset(closes, start_day=1, month="2023-06", **more):
    bars = [{"timestamp": f"{month}-{start_day + i:02d}", "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 1000} for i, c in enumerate(closes)]
    return {"symbol": "X", "source": "t", "currency": "USD", "bars": bars, **more}


def tables(spark, **named):
    return parse_json(spark.createDataFrame([(k, json.dumps(v)) for k, v in named.items()], "dataset_id string, text string"))


def found(spark, data, cfg=engine.Config()):
    reports, findings = engine.check(tables(spark, d=data), cfg)
    return reports.first().sanity_score, {(r.rule, r.severity): r for r in findings.collect()}


def test_split_without_record_and_with(spark):
    closes = [99.0, 99.4, 99.1, 99.3, 49.7, 49.6, 49.8, 49.7, 49.9, 49.8]
    score, got = found(spark, dataset(closes))
    assert score == 60 and [k for k in got] == [("SPLIT_NOT_ADJUSTED", "critical")]
    assert got[("SPLIT_NOT_ADJUSTED", "critical")].where_date == "2023-06-05" and got[("SPLIT_NOT_ADJUSTED", "critical")].action == "block"
    assert found(spark, dataset(closes, splits=[{"exDate": "2023-06-05", "numerator": 2, "denominator": 1}])) == (100, {})


def test_bad_tick(spark):
    closes = [621000.0, 622000.0, 620500.0, 621500.0, 620000.0, 185.15, 621000.0, 622000.0, 620500.0, 621500.0, 620900.0, 621100.0]
    score, got = found(spark, dataset(closes))
    assert score == 45 and set(got) == {("PRICE_SPIKE_INTRADAY", "critical"), ("RETURN_SPIKE", "warning")}
    assert got[("RETURN_SPIKE", "warning")].occurrences == 2


def test_duplicate_dividend_and_few_bars(spark):
    d = dataset([60.0, 60.1, 60.2, 60.1], dividends=[{"exDate": "2023-06-02", "amount": 0.21, "type": "regular"}, {"exDate": "2023-06-03", "amount": 0.21, "type": "regular"}])
    score, got = found(spark, d)
    assert score == 70 and set(got) == {("DIV_DUPLICATED", "warning"), ("INSUFFICIENT_DATA", "warning")}


def test_degenerate_datasets_and_disabled_rules(spark):
    nan = dataset([10.0, 11.0])
    nan["bars"][0]["close"] = None
    sets = {"none": dataset([]), "one": dataset([1.0]), "nan": nan, "flat": dataset([5.0] * 12), "zero": dataset([0.0, -1.0, 2.0]), "bad_time": {**dataset([1.0, 2.0]), "bars": [{"timestamp": "never", "open": 1, "high": 1, "low": 1, "close": 1}] * 2}}
    t = tables(spark, **sets)
    reports, findings = engine.check(t)
    scores = {r.dataset_id: r.sanity_score for r in reports.collect()}
    rules = {(r.dataset_id, r.rule, r.severity) for r in findings.collect()}
    assert set(scores) == set(sets) and ("none", "INSUFFICIENT_DATA", "critical") in rules and ("flat", "STALE_PRICE", "warning") in rules and ("bad_time", "TS_DUPLICATED", "critical") in rules
    assert len(CHECK_RULES) == len(CHECKS) == 29
    off = engine.Config({r: engine.Override(enabled=False) for r in CHECKS})
    assert engine.check(t, off)[1].count() == 0 and engine.check(t, off)[0].filter("sanity_score < 100").count() == 0
    forced = engine.Config({"STALE_PRICE": engine.Override(severity="info")})
    assert engine.check(t, forced)[1].filter("rule = 'STALE_PRICE' AND severity = 'info' AND action = 'review'").count() == 1


def test_compare(spark):
    a = dataset([100.0 + i for i in range(12)], dividends=[{"exDate": "2023-06-05", "amount": 1.0}])
    b = {**dataset([102.0 + i for i in range(12)], dividends=[{"exDate": "2023-06-06", "amount": 1.5}]), "symbol": "Y"}
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, a_id string, b_id string")
    reports, findings = compare(PairTables(pairs, tables(spark, a=a, b=b)))
    r = reports.first()
    assert {f.rule for f in findings.collect()} == {"SYMBOL_MISMATCH", "CLOSE_DIVERGENCE", "DIVIDEND_MISMATCH"}
    assert r.consistency_score == 30 and r.compared_dates == 12 and r.source_a == "t (A)"


def test_columns(spark):
    rows = [("2024-01-05", "2024-01-08", "US0378331005", "20240230"), ("2024-01-05", "2024-01-15", "US0378331006", "20240229"), ("2024-01-05", "2024-01-05", "x", "1704067200"), (None, "2024-01-05", None, "Jan 2, 2024")]
    df = spark.createDataFrame(rows, "a string, b string, isin string, ts string")
    got = df.select(tf.weekdays_between(tf.to_ms(F.col("a")), tf.to_ms(F.col("b"))), tf.isin_valid(F.col("isin")), tf.normal_timestamp(F.col("ts"))).collect()
    assert [r[0] for r in got] == [0, 5, 0, 0] and [r[1] for r in got] == [True, False, False, None]
    assert [r[2] for r in got] == ["20240230", "2024-02-29", "2024-01-01", "Jan 2, 2024"]
    r = spark.range(1).select(tf.split_label(F.lit(47.5 / 100 - 1), 0.05), tf.middle(F.array(F.lit(4.0), F.lit(2.0))), tf.finite(F.lit(float("nan")))).first()
    assert r[0] == "2:1" and r[1] == 3.0 and r[2] is False


def test_ingest(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("Date,O,H,L,C,Vol\n20230602,1,2,0.5,1.5,10\n2023-06-01,1,2,0.5,1.6,\n")
    t = read_file(spark, f"file://{good}", symbol="S")
    assert [(b.seq, b.ts_raw, b.close, b.volume) for b in t.bars.orderBy("seq").collect()] == [(0, "2023-06-02", 1.5, 10.0), (1, "2023-06-01", 1.6, None)]
    with pytest.raises(IngestError):
        header_map(["date", "open", "close"])
    with pytest.raises(IngestError):
        read_file(spark, "x.xml")
    texts = spark.createDataFrame([("a", '[{"timestamp":"2023-06-01","open":1,"high":1,"low":1,"close":1}]'), ("b", "{"), ("c", "{}")], "dataset_id string, text string")
    assert {r.dataset_id for r in bad_json(texts).collect()} == {"b", "c"}
    assert parse_json(texts.filter("dataset_id = 'a'"), "N").datasets.first().symbol == "N"
    chart = {"chart": {"result": [{"meta": {"symbol": "Q", "currency": "USD", "gmtoffset": -14400}, "timestamp": [1704205800, 1704292200], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [1, 1], "close": [2, 2], "volume": [5, 5]}], "adjclose": [{"adjclose": [1.0, 1.0]}]}, "events": {"splits": {"1": {"date": 1704205800, "numerator": 2, "denominator": 1}}}}]}}
    t = parse_chart(spark.createDataFrame([("q", json.dumps(chart))], "dataset_id string, text string"))
    assert [(b.ts_raw, b.adj_factor) for b in t.bars.collect()] == [("2024-01-02", 0.5)] and t.splits.first().numerator == 2
    day = {"1. open": "1", "2. high": "1", "3. low": "1", "4. close": "2", "5. adjusted close": "1", "6. volume": "3", "7. dividend amount": "0.5", "8. split coefficient": "1.0"}
    t = parse_daily_series(spark.createDataFrame([("s", json.dumps({"Time Series (Daily)": {"2024-01-03": day, "2024-01-02": {**day, "4. close": "0"}}}))], "dataset_id string, text string"))
    assert [b.ts_raw for b in t.bars.collect()] == ["2024-01-03"] and t.dividends.count() == 2


def test_schema_findings_block_the_rules(spark):
    bad = dataset([1.0] * 12)
    for b in bad["bars"]:
        b["close"] = None
        b["open"] = None
    t = tables(spark, bad=bad, good=dataset([5.0, 5.1, 5.2] * 4))
    invalid = schema_findings(t)
    reports, findings = engine.check(t, invalid=invalid)
    rows = findings.filter("dataset_id = 'bad'").collect()
    assert len(rows) == 20 and {r.rule for r in rows} == {"SCHEMA_INVALID"} and max(r.occurrences for r in rows) == 24
    assert {r.dataset_id: r.sanity_score for r in reports.collect()}["bad"] == 0


def test_history_gate_config_html(spark, tmp_path):
    t = tables(spark, d=dataset([5.0] * 12))
    reports, findings = engine.check(t)
    for at in ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"):
        history.append(engine.history_entries(reports, findings, at), str(tmp_path / "h"))
    (tmp_path / "h" / "symbol_key=X" / "part-damaged.json").write_text("not json\n")
    entries = history.read(spark, str(tmp_path / "h"))
    assert entries.count() == 2 and history.trend(entries).first().trend == "stable"
    assert engine.gate(reports, fail_on="warning").first().exit_code == 1 and engine.gate(reports).first().exit_code == 0
    with pytest.raises(config.ConfigError):
        config.parse({"rules": {"NOPE": {}}})
    with pytest.raises(config.ConfigError):
        config.parse({"rules": {"STALE_PRICE": {"params": {"consecutiveSessions": float("inf")}}}})
    assert config.parse({"rules": {"STALE_PRICE": {"enabled": False}}}).rules["STALE_PRICE"].enabled is False
    page = report_html.page("<X>", 85, {"warning": 1}, [{"rule": "STALE_PRICE", "severity": "warning", "explanation": "</script>"}], [1.0, 2.0])
    assert "<X>" not in page and page.count("</script>") == 1 and report_html.safe_href("javascript:x") is None
    assert engine.rule_catalog(spark).count() == 36


def test_tasks_of_windows_stay_small(spark):
    # A task's sorts grow with its share of the bars; with more bars there are more tasks, not larger ones.
    n = F.col("id")
    bars = spark.range(400_000).select(
        F.concat(F.lit("d"), (n % 4000).cast("string")).alias("dataset_id"), (n / 4000).cast("int").alias("seq"), n.cast("string").alias("ts_raw"), n.alias("t"),
        *(F.rand(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume", "adj_factor"))),
    )
    nothing = spark.createDataFrame([], "dataset_id string")
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "200"}
    with held(spark, settings):
        enriched = MarketTables(nothing, bars, nothing, nothing).written(bars=False).enriched
    files = len(enriched.inputFiles())
    assert files > 4  # the cores of this session
    assert enriched.count() == 400_000

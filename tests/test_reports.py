import csv
import json

import pytest
from test_market import dataset, tables

from tickvet.operators import engine, report_data, scoreboard
from tickvet.operators.catalog import CHECK_RULES, COMPARE_RULES, REFERENCES
from tickvet.operators.report_html import overlay, page
from tickvet.sources import daily_series_errors, read_file

WAVE = [100.0, 100.4, 100.1, 100.5, 100.2, 100.6, 100.3, 100.0, 100.5, 100.1, 100.4, 100.2]


def factors(data, value):
    for bar in data["bars"]:
        bar["adjustmentFactor"] = value
    return data


CASES = {  # dataset, score, findings in order: rule, severity, action, date
    "unadjusted dividend": (factors(dataset(WAVE[:8], dividends=[{"exDate": "2023-06-06", "amount": 1.6, "type": "regular"}]), 1.0), 70, [("DIV_NOT_ADJUSTED", "warning", "flag", "2023-06-06"), ("INSUFFICIENT_DATA", "warning", "flag", None)]),
    "country of the ISIN": ({**dataset(WAVE[:5], exchange="LSE", identifiers={"isin": "US0378331005"}), "currency": "GBP"}, 70, [("INSUFFICIENT_DATA", "warning", "flag", None), ("SYMBOL_MAPPING_SUSPECT", "warning", "flag", None)]),
    "pounds to pence": ({**dataset([3.0, 3.02, 3.01, 3.03, 3.02, 301.0, 302.0, 301.5, 302.5, 301.0]), "currency": "GBP"}, 85, [("CURRENCY_SCALE_SUSPECT", "warning", "flag", "2023-06-06")]),
    "bars only": (dataset(WAVE[:2])["bars"], 80, [("INSUFFICIENT_DATA", "warning", "flag", None), ("CURRENCY_SUSPECT", "info", "review", None)]),
    "reverse split on record": (dataset([13.0, 13.1, 13.05, 13.15, 13.1, 104.8, 105.2, 104.9, 105.1, 105.0], splits=[{"exDate": "2023-06-06", "numerator": 1, "denominator": 8}]), 100, []),
    "market cap": (dataset(WAVE[:5], fundamentals={"marketCap": 5e11, "sharesOutstanding": 1e10}), 70, [("INSUFFICIENT_DATA", "warning", "flag", None), ("MARKETCAP_MISMATCH", "warning", "flag", "2023-06-05")]),
    "dividend in pence": (dataset([2.0, 2.01, 2.02, 2.0, 2.01, 2.0, 2.02, 2.01], dividends=[{"exDate": "2023-06-05", "amount": 1.8, "type": "regular"}]), 55, [("DIV_SCALE_100X", "warning", "flag", "2023-06-05"), ("DIV_YIELD_IMPOSSIBLE", "warning", "flag", "2023-06-08"), ("INSUFFICIENT_DATA", "warning", "flag", None)]),
    "factor without an action": (factors(dataset(WAVE[:10]), 0.96), 85, [("CORPORATE_ACTION_MISSING_FROM_FACTOR", "warning", "flag", "2023-06-01")]),
    "foreign dividend": (dataset(WAVE, dividends=[{"exDate": "2023-06-06", "amount": 0.2, "currency": "EUR", "type": "regular"}]), 85, [("DIVIDEND_FX_MISMATCH", "warning", "flag", "2023-06-06")]),
    "late drop": (dataset([*WAVE, 100.3, 100.5, 95.6, 95.8, 95.5, 95.9, 95.7, 95.6], dividends=[{"exDate": "2023-06-06", "amount": 4.7, "type": "regular"}]), 70, [("EXDATE_MISPLACED", "warning", "flag", "2023-06-06"), ("RETURN_SPIKE", "warning", "flag", "2023-06-15")]),
    "clean": (dataset(WAVE), 100, []),
}


@pytest.fixture(scope="module")
def checked(spark):
    t = tables(spark, **{k: d for k, (d, _, _) in CASES.items()})
    reports, findings = engine.check(t)
    return t, reports, findings


def test_whole_reports(checked):
    _, reports, findings = checked
    scores = {r.dataset_id: r.sanity_score for r in reports.collect()}
    got = {r.dataset_id: [(f.rule, f.severity, f.action, f.where_date) for f in r.findings] for r in engine.ordered_findings(findings).collect()}
    for name, (_, score, want) in CASES.items():
        assert (scores[name], got.get(name, [])) == (score, want), name


def test_references(checked):
    links = {f.rule: f.references for r in engine.ordered_findings(checked[2]).collect() for f in r.findings}
    assert links["INSUFFICIENT_DATA"] == []
    assert links["MARKETCAP_MISMATCH"] == ["https://quant.stackexchange.com/questions/23085/correct-alphabet-google-market-cap-calculation"]
    assert len(links["CURRENCY_SCALE_SUSPECT"]) == 2
    assert set(REFERENCES) <= {*CHECK_RULES, *COMPARE_RULES}
    html = page("X", 85, {"warning": 1}, [{"rule": "R", "severity": "warning", "explanation": "", "references": ["https://example.org/?a=1&b=2", "javascript:alert(1)"]}])
    assert 'href="https://example.org/?a=1&amp;b=2"' in html and 'href="javascript' not in html


def test_overlay():
    days = [("2023-06-01", 100.0, 100.0), ("2023-06-02", 100.0, 103.0), ("2023-06-05", 101.0, 104.0), ("2023-06-06", float("nan"), 1.0), ("2023-06-07", None, 1.0)]
    found = [{"rule": "R", "where_date": None}, {"rule": "Q", "where_date": "2023-06-05"}, {"rule": "P", "where_date": "2023-06-05"}]
    svg = overlay(days, ("<a>", "b"), found)
    assert svg.count("<polyline") == 2 and "3 shared days, 2 more than 2% apart" in svg and svg.count('class="mark"') == 2
    assert svg.count("<a href") == 1 and '<a href="#f1">' in svg and "&lt;a&gt;: 100.00 to 101.00" in svg and "b: 100.00 to 104.00" in svg
    assert overlay([], ("a", "b"), []) == "" == overlay(days[3:], ("a", "b"), [])
    one = overlay(days[:1], ("a", "b"), [])
    assert "<polyline" not in one and one.count("<circle") == 2
    zero = overlay([("2023-06-01", 0.0, 0.0), ("2023-06-02", -1.0, -2.0)], ("a", "b"), [])
    assert "0 more than" in zero


def test_report_data(spark, checked):
    t, _, findings = checked
    marks = {(r.dataset_id, r.where_date): r.rule for r in report_data.marks_by_date(findings).collect()}
    assert marks[("late drop", "2023-06-15")] == "RETURN_SPIKE" and ("clean", None) not in marks
    bars = spark.createDataFrame([("d", 10, 1, 1.0), ("d", 20, 2, 2.0), ("d", 20, 3, 3.0), ("d", 30, 4, 4.0)], "dataset_id string, t long, rn int, close double")
    events = spark.createDataFrame([("d", 0, 5), ("d", 1, 11), ("d", 2, 20), ("d", 3, 31)], "dataset_id string, seq int, ex_t long")
    assert {r.seq: r.bar and (r.bar.rn, r.bar.close) for r in report_data.first_bar_on_or_after(events, bars).collect()} == {0: (1, 1.0), 1: (2, 2.0), 2: (2, 2.0), 3: None}
    aligned = spark.createDataFrame([("d", "1", 100.0, 101.0), ("d", "2", 100.0, 103.0), ("d", "3", 0.0, 0.0), ("d", "4", None, 1.0)], "dataset_id string, day string, a_close double, b_close double")
    assert [r.day for r in report_data.divergences(aligned).collect()] == ["2"]


def test_scoreboard_files(spark, checked, tmp_path):
    _, reports, findings = checked
    failed = spark.createDataFrame([("t", 'GO"NE, Inc')], "source string, symbol string")
    rows = scoreboard.symbol_rows(reports, findings, failed)
    scoreboard.publish(rows, str(tmp_path / "out"), "2024-01-01T00:00:00Z", [{"symbol": "X", "consistency_score": 85}])
    board = json.loads((tmp_path / "out" / "latest.json").read_text())
    one = next(b for b in board["providers"] if b["provider"] == "t")
    warnings = sum(f[1] == "warning" for k, (_, _, found) in CASES.items() if k != "bars only" for f in found)  # that one has no source
    assert (one["symbols_ok"], one["symbols_failed"], one["min_score"], one["warning"]) == (10, 1, 55, warnings) and one["worst_symbols"][0]["rules"] == ["DIV_SCALE_100X", "DIV_YIELD_IMPOSSIBLE", "INSUFFICIENT_DATA"]
    lines = list(csv.DictReader((tmp_path / "out" / "latest.csv").open()))
    assert len(lines) == 12 and [x for x in lines if x["rules"] == "FETCH_FAILED"][0]["symbol"] == 'GO"NE, Inc'
    assert [f["name"] for f in json.loads((tmp_path / "out" / "datapackage.json").read_text())["resources"][0]["schema"]["fields"]] == list(lines[0])
    assert "| t | 10 (+1 failed) |" in (tmp_path / "out" / "README.md").read_text()
    many = spark.createDataFrame([("t", f"F{i}") for i in range(3)], "source string, symbol string")
    with pytest.raises(scoreboard.QuorumError):
        scoreboard.publish(scoreboard.symbol_rows(reports, findings, many), str(tmp_path / "none"), "x")
    assert not (tmp_path / "none").exists()


def test_quoted_csv_and_vendor_errors(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Note,"Date",Open,High,Low,Close,Volume\n"a, b",2023-06-01,1,2,0.5,"1.5",10\n"say ""x, y""","2023-06-02",1,2,0.5,1.6,11\nplain,2023-06-03,1,2,0.5,1.7,12\n')
    got = read_file(spark, f"file://{path}").bars.orderBy("seq").collect()
    assert [(b.ts_raw, b.open, b.close, b.volume) for b in got] == [("2023-06-01", 1.0, 1.5, 10.0), ("2023-06-02", 1.0, 1.6, 11.0), ("2023-06-03", 1.0, 1.7, 12.0)]
    texts = {"limit": '{"Note": "25 requests"}', "bad": '{"Error Message": "no symbol"}', "info": '{"Information": "key"}', "none": "{}", "broken": "{", "good": '{"Time Series (Daily)": {"2024-01-02": {"4. close": "1"}}}'}
    errors = {r.dataset_id: r.error for r in daily_series_errors(spark.createDataFrame(list(texts.items()), "dataset_id string, text string")).collect()}
    assert errors == {"limit": "Note: 25 requests", "bad": "Error Message: no symbol", "info": "Information: key", "none": "no daily series", "broken": "not a JSON object"}

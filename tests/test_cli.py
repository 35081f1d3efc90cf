import json

from tickvet import cli


def write(path, closes, **more):
    bars = [{"timestamp": f"2023-06-{1 + i:02d}", "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 1000} for i, c in enumerate(closes)]
    path.write_text(json.dumps({"symbol": "X", "source": "t", "currency": "USD", "bars": bars, **more}))
    return str(path)


def test_arguments(capsys):
    assert cli.main([]) == 0 and "check" in capsys.readouterr().out
    for wrong in (["check"], ["check", "--file", "x.csv", "--fail-on", "never"], ["check", "--file", "x.csv", "--min-score", "101"], ["check", "--file", "x.csv", "--format", "xml"], ["check", "--provider", "yahoo"], ["compare", "--files", "a.json"]):
        assert cli.main(wrong) == 2
    assert cli.main(["providers"]) == 0 and "yahoo" in capsys.readouterr().out
    assert cli.main(["rules", "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 36


def test_check_and_history(spark, tmp_path, capsys):
    bad = write(tmp_path / "bad.json", [99.0, 99.4, 99.1, 99.3, 49.7, 49.6, 49.8, 49.7, 49.9, 49.8])
    page, kept = tmp_path / "page.html", str(tmp_path / "h")
    assert cli.main(["check", "--file", bad, "--format", "json", "--html", str(page), "--save", "--history-dir", kept]) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["sanity_score"] == 60 and out["findings"][0]["rule"] == "SPLIT_NOT_ADJUSTED" and "polyline" in page.read_text()
    good = write(tmp_path / "good.json", [5.0, 5.1, 5.2, 5.15] * 3)
    assert cli.main(["check", "--file", good]) == 0 and "100/100" in capsys.readouterr().out
    assert cli.main(["check", "--file", bad, "--min-score", "90", "--config", str(tmp_path / "none.json")]) == 2
    assert cli.main(["check", "--file", str(tmp_path / "none.json")]) == 2
    assert cli.main(["history", "x", "--history-dir", kept]) == 0 and "SPLIT_NOT_ADJUSTED" in capsys.readouterr().out


def test_faults_of_structure_are_told_by_path(spark, tmp_path, capsys):
    path = write(tmp_path / "wrong.json", [5.0, 5.1], currency="usd", splits=[{"exDate": "2023-06-02", "numerator": "2", "denominator": 1}])
    assert cli.main(["check", "--file", path, "--format", "json"]) == 1
    out = json.loads(capsys.readouterr().out)
    told = {json.loads(f["evidence"])["path"]: f["explanation"] for f in out["findings"] if f["rule"] == "SCHEMA_INVALID"}
    assert set(told) == {"currency", "splits.0.numerator"} and "expected number, received string" in told["splits.0.numerator"]


def test_compare(spark, tmp_path, capsys):
    a = write(tmp_path / "a.json", [100.0 + i for i in range(12)])
    b = write(tmp_path / "b.json", [102.0 + i for i in range(12)])
    html = tmp_path / "c.html"
    code = cli.main(["compare", "--files", f"{a},{b}", "--fail-on", "info", "--format", "json", "--html", str(html)])
    assert html.read_text().count("<polyline") == 2 and "12 shared days, 0 more than 2% apart" in html.read_text()
    out = json.loads(capsys.readouterr().out)
    assert code == 1 and out["compared_dates"] == 12 and any(f["rule"] == "CLOSE_DIVERGENCE" for f in out["findings"])

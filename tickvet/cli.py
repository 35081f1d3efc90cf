"""Command line: python -m tickvet.cli {check, compare, history, rules, providers}.

Exit codes: 0 all gates hold, 1 a gate failed, 2 wrong arguments or input that can't be read. Arguments are checked before
anything is read, fetched or written.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.operators import config, engine
from tickvet.operators.catalog import CHECK_RULES, COMPARE_RULES, SEVERITIES
from tickvet.operators.compare import PairTables, compare
from tickvet.operators.report_data import thinned
from tickvet.operators.report_html import overlay, page
from tickvet.operators.tables import MarketTables
from tickvet.sources import IngestError, chart_errors, daily_series_errors, history, parse_chart, parse_daily_series, read_file, schema_findings, structure
from tickvet.sources.connectors import CONNECTORS, ConnectorError, VendorSource, connector_status, get_connector


def _score(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 100:
        raise argparse.ArgumentTypeError("must be a number between 0 and 100")
    return value


def _parser() -> argparse.ArgumentParser:
    gates = argparse.ArgumentParser(add_help=False)
    gates.add_argument("--fail-on", choices=SEVERITIES, default="critical", help="fail on findings of this severity or worse")
    gates.add_argument("--min-score", type=_score, help="fail below this score")
    gates.add_argument("--format", type=str.lower, choices=("table", "json"), default="table")
    gates.add_argument("--html", help="write an HTML page here")
    gates.add_argument("--config", help="JSON file of rule overrides")
    gates.add_argument("--range", default="1y", help="how far back a provider is asked")
    parser = argparse.ArgumentParser(prog="tickvet", description="Audit daily market data.")
    commands = parser.add_subparsers(dest="command")
    one = commands.add_parser("check", parents=[gates], help="check one dataset")
    source = one.add_mutually_exclusive_group(required=True)
    source.add_argument("--file", help="CSV or JSON file")
    source.add_argument("--provider", choices=CONNECTORS)
    one.add_argument("--symbol", help="symbol to fetch, or name of a file that carries none")
    one.add_argument("--save", action="store_true", help="append to the history")
    one.add_argument("--history-dir", default=".tickvet-history")
    two = commands.add_parser("compare", parents=[gates], help="compare two sources")
    source = two.add_mutually_exclusive_group(required=True)
    source.add_argument("--files", help="two files, separated by a comma")
    source.add_argument("--providers", help="two providers, separated by a comma")
    two.add_argument("--symbol")
    past = commands.add_parser("history", help="past scores of a symbol")
    past.add_argument("symbol")
    past.add_argument("--history-dir", default=".tickvet-history")
    past.add_argument("--limit", type=int, default=20)
    rules = commands.add_parser("rules", help="list the rules")
    rules.add_argument("--format", type=str.lower, choices=("table", "json"), default="table")
    commands.add_parser("providers", help="list the providers")
    return parser


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("tickvet").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = (builder if os.environ.get("SPARK_REMOTE") or os.environ.get("MASTER") else builder.config("spark.sql.shuffle.partitions", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _file(spark: SparkSession, path: str, symbol: str | None, source: str | None = None) -> MarketTables:
    return read_file(spark, path if "://" in path else f"file://{os.path.abspath(path)}", symbol, source)


def _structure(spark: SparkSession, args, t: MarketTables) -> DataFrame:
    """Structural findings: of a JSON file by the paths of its text, else of the tables."""
    if not args.file or not args.file.lower().endswith(".json"):
        return schema_findings(t)
    path = args.file if "://" in args.file else f"file://{os.path.abspath(args.file)}"
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("dataset_id"), F.col("value").alias("text"))
    return structure.findings(structure.issues(texts, args.symbol or "UNKNOWN", "json"))


def _fetched(spark: SparkSession, provider: str, symbol: str, span: str) -> MarketTables:
    get_connector(provider)
    spark.dataSource.register(VendorSource)
    raw = spark.read.format("vendor_daily").option("provider", provider).option("symbols", symbol).option("range", span).load().persist()
    errors = raw.filter("error IS NOT NULL").select("dataset_id", "error")
    told = chart_errors if provider == "yahoo" else daily_series_errors
    errors = errors.unionByName(told(raw.filter("error IS NULL")))
    if bad := errors.first():
        raise ConnectorError(f"{provider}: {bad.dataset_id}: {bad.error}")
    return parse_chart(raw) if provider == "yahoo" else parse_daily_series(raw, symbol)


def _renamed(t: MarketTables, name: str) -> MarketTables:
    return MarketTables(*(x.withColumn("dataset_id", F.lit(name)) for x in (t.datasets, t.bars, t.dividends, t.splits)))


def _both(a: MarketTables, b: MarketTables) -> MarketTables:
    return MarketTables(*(getattr(a, x).unionByName(getattr(b, x)) for x in ("datasets", "bars", "dividends", "splits")), cache=True)


def _print(report: dict, score: str, findings: list[dict], form: str, coverage: str = "") -> None:
    if form == "json":
        print(json.dumps({**report, "findings": findings}, indent=2, default=str))
        return
    print(f"{report['symbol']}: {score.replace('_', ' ')} {report[score]}/100 (" + ", ".join(f"{report[s]} {s}" for s in SEVERITIES) + ")")
    if coverage:
        print(coverage)
    for f in findings:
        print(f"  {f['severity']:8} {f['action']:6} {f['rule']}: {f['explanation']}")


def _finish(args, reports: DataFrame, findings: DataFrame, score: str, closes: list[float] = (), days: list[tuple] = ()) -> int:
    """Print, write and gate the one report; days: the closes of a comparison's shared days."""
    gated = engine.gate(reports, args.fail_on, args.min_score, score).first().asDict()
    found = engine.ordered_findings(findings).first()
    rows = [f.asDict() for f in found.findings] if found else []
    reasons, code = gated.pop("reasons"), gated.pop("exit_code")
    only = {k: v for k, v in gated.items() if k.startswith("only_in")}
    coverage = f"  compared dates {gated['compared_dates']}" + "".join(f", {k.replace('_', ' ')}: {v}" for k, v in only.items()) if "compared_dates" in gated else ""
    gated["generated_at"] = datetime.now(UTC).isoformat()
    _print(gated, score, rows, args.format, coverage)
    if args.html:
        chart = overlay(days, (gated["source_a"], gated["source_b"]), rows) if days else ""
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(page(f"{gated['symbol']}", gated[score], {s: gated[s] for s in SEVERITIES}, rows, closes, chart))
    for reason in reasons:
        print(f"gate failed: {reason}", file=sys.stderr)
    return code


def _check(args, cfg) -> int:
    spark = _session()
    t = _file(spark, args.file, args.symbol) if args.file else _fetched(spark, args.provider, args.symbol, args.range)
    t = t.written()
    reports, findings = engine.check(t, cfg, _structure(spark, args, t))
    closes = [r.close for r in thinned(t.bars.filter("close IS NOT NULL"), ["seq"], ["close"]).orderBy("point").select("close").collect()] if args.html else []
    code = _finish(args, reports, findings, "sanity_score", closes)
    if args.save:
        history.append(engine.history_entries(reports, findings, datetime.now(UTC).isoformat()), args.history_dir)
    return code


def _compare(args, cfg) -> int:
    spark, names = _session(), (args.files or args.providers).split(",")
    if args.files:
        a, b = (_file(spark, n.strip(), args.symbol, os.path.basename(n.strip())) for n in names)
    else:
        a, b = (_fetched(spark, n.strip(), args.symbol, args.range) for n in names)
    t = _both(_renamed(a, "a"), _renamed(b, "b"))
    if bad := schema_findings(t).first():
        print(f"dataset {bad.dataset_id}: {bad.explanation}", file=sys.stderr)
        return 2
    pairs = spark.createDataFrame([("pair", "a", "b")], "pair_id string, a_id string, b_id string")
    both = PairTables(pairs, t)
    reports, findings = compare(both, cfg)
    days = [tuple(r) for r in both.aligned.filter("in_a AND in_b").orderBy("day").select("day", "a_close", "b_close").collect()] if args.html else []
    return _finish(args, reports, findings, "consistency_score", days=days)


def _history(args) -> int:
    spark = _session()
    key = spark.range(1).select(history.symbol_key(F.lit(args.symbol))).first()[0]
    entries = history.read(spark, args.history_dir, args.limit).filter(F.col("symbol_key") == key).persist()
    rows = entries.orderBy(F.desc("at")).collect()
    for r in rows:
        print(f"{r.at}  {r.sanity_score:3}  {r.source}  {' '.join(r.rules)}")
    print(f"trend: {history.trend(entries).first().trend}" if rows else f"no history of {args.symbol}")
    return 0


def _rules(args) -> int:
    kinds = (("check", CHECK_RULES), ("compare", COMPARE_RULES))
    if args.format == "json":
        print(json.dumps([{"id": r.id, "kind": k, "severity": r.severity, "dimension": r.dimension, "description": r.description, "params": dict(r.params)} for k, rules in kinds for r in rules.values()], indent=2))
    else:
        for kind, rules in kinds:
            for r in rules.values():
                print(f"{kind:8}{r.severity:9}{r.id}: {r.description}" + (f" {dict(r.params)}" if r.params else ""))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command is None:
        parser.print_help()
        return 0
    if args.command == "providers":
        for name, available, key in connector_status():
            print(f"{name:16}{'available' if available else f'needs {key}'}")
        return 0
    if args.command == "rules":
        return _rules(args)
    pair = args.command == "compare" and (args.files or args.providers)
    if pair and len([x for x in pair.split(",") if x.strip()]) != 2:
        print("name two, separated by a comma", file=sys.stderr)
        return 2
    if (getattr(args, "provider", None) or getattr(args, "providers", None)) and not args.symbol:
        print("--symbol is needed to fetch", file=sys.stderr)
        return 2
    try:
        if args.command == "history":
            return _history(args)
        cfg = config.load(args.config)
        return (_check if args.command == "check" else _compare)(args, cfg)
    except (IngestError, ConnectorError, config.ConfigError) as e:
        print(e, file=sys.stderr)
    except AnalysisException as e:
        print("no such file" if e.getCondition() == "PATH_NOT_FOUND" else e, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())

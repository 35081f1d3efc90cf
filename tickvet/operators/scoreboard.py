"""A scoreboard of sources as files: JSON, Markdown, CSV and the CSV's data package."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.operators.catalog import SEVERITIES

FIELDS = {"generated_at": "datetime", "provider": "string", "symbol": "string", "sanity_score": "integer", "critical": "integer", "warning": "integer", "info": "integer", "rules": "string"}


class QuorumError(RuntimeError):
    """Too many symbols of a source could not be fetched."""


def symbol_rows(reports: DataFrame, findings: DataFrame, failed: DataFrame) -> DataFrame:
    """(provider, symbol, sanity_score, critical, warning, info, rules) of every symbol; failed: source, symbol, whose rules are FETCH_FAILED."""
    order = F.array_sort(F.collect_list(F.struct("severity_rank", "rule_rank", "rule")))
    rules = findings.groupBy("dataset_id").agg(F.array_join(F.transform(order, lambda x: x["rule"]), ";").alias("rules"))
    good = reports.join(rules, "dataset_id", "left").select(F.col("source").alias("provider"), "symbol", "sanity_score", *SEVERITIES, F.coalesce("rules", F.lit("")).alias("rules"))
    none = [F.lit(None).cast("int").alias("sanity_score"), *(F.lit(None).cast("long").alias(s) for s in SEVERITIES)]
    return good.unionByName(failed.select(F.col("source").alias("provider"), "symbol", *none, F.lit("FETCH_FAILED").alias("rules")))


def providers(rows: DataFrame, most_failed: float = 0.2) -> DataFrame:
    """(provider, symbols_ok, symbols_failed, mean_score, min_score, totals by severity, quorum) of symbol_rows(); quorum is false beyond most_failed."""
    bad = F.col("rules") == "FETCH_FAILED"
    out = rows.groupBy("provider").agg(
        F.count_if(~bad).alias("symbols_ok"), F.count_if(bad).alias("symbols_failed"), F.coalesce(F.round(F.avg("sanity_score"), 1), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.min("sanity_score"), F.lit(0)).alias("min_score"), *(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SEVERITIES),
    )
    return out.withColumn("quorum", F.col("symbols_failed") <= most_failed * (F.col("symbols_ok") + F.col("symbols_failed")))


def publish(rows: DataFrame, folder: str, at: str, comparisons: list[dict] = (), most_failed: float = 0.2) -> None:
    """Write latest.json, README.md, latest.csv and datapackage.json for a basket of symbols; nothing if a source lacks its quorum."""
    board = [r.asDict() for r in providers(rows, most_failed).orderBy("provider").collect()]
    if short := [b for b in board if not b.pop("quorum")]:
        raise QuorumError("; ".join(f"{b['provider']}: {b['symbols_failed']} of {b['symbols_failed'] + b['symbols_ok']} symbols failed" for b in short))
    all_rows = [r.asDict() for r in rows.orderBy("provider", "symbol").collect()]
    for b in board:
        own = sorted((r for r in all_rows if r["provider"] == b["provider"] and r["sanity_score"] is not None), key=lambda r: r["sanity_score"])
        b["worst_symbols"] = [{"symbol": r["symbol"], "score": r["sanity_score"], "rules": r["rules"].split(";") if r["rules"] else []} for r in own[:5]]
    os.makedirs(folder, exist_ok=True)
    files = {
        "latest.json": json.dumps({"generated_at": at, "providers": board, "comparisons": list(comparisons)}, indent=2),
        "README.md": _markdown(board, at, list(comparisons)),
        "datapackage.json": json.dumps({"profile": "tabular-data-package", "name": "scoreboard", "created": at, "resources": [{"name": "scoreboard", "path": "latest.csv", "profile": "tabular-data-resource", "schema": {"fields": [{"name": n, "type": t} for n, t in FIELDS.items()]}}]}, indent=2),
    }
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text + "\n")
    with open(os.path.join(folder, "latest.csv"), "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, FIELDS, lineterminator="\n")
        out.writeheader()
        out.writerows({"generated_at": at, **r} for r in all_rows)


def _markdown(board: list[dict], at: str, comparisons: list[dict]) -> str:
    lines = ["# Scoreboard", "", f"Generated: {at}", "", "| Provider | Symbols | Mean score | Min | Critical | Warning | Info |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {b['provider']} | {b['symbols_ok']} (+{b['symbols_failed']} failed) | {b['mean_score']} | {b['min_score']} | {b['critical']} | {b['warning']} | {b['info']} |" for b in board]
    for b in board:
        lines += ["", f"## Worst of {b['provider']}", "", *(f"- {w['symbol']}: {w['score']} ({', '.join(w['rules']) or 'clean'})" for w in b["worst_symbols"])]
    if comparisons:
        lines += ["", "## Between providers", "", *(f"- {json.dumps(c)}" for c in comparisons)]
    return "\n".join(lines)

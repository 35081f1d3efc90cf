"""A self-contained HTML page of one report: score, counts, findings, and a price line or two sources' closes."""

from __future__ import annotations

import json
from html import escape
from math import isfinite

_STYLE = "body{font:15px sans-serif;margin:2em auto;max-width:60em}.critical{color:#b00020}.warning{color:#9a6700}.info{color:#0550ae}article{border:1px solid #ccc;padding:.6em;margin:.6em 0}svg{width:100%}polyline.s1{stroke:#0550ae}polyline.s2{stroke:#1a7f37}circle.s1,li.s1{fill:#0550ae;color:#0550ae}circle.s2,li.s2{fill:#1a7f37;color:#1a7f37}circle.mark{fill:#b00020}"


def esc(x) -> str:
    return escape(str(x), quote=True)


def safe_href(url: str) -> str | None:
    return url if url.startswith(("https://", "http://")) else None


def band(score: int) -> str:
    return next(text for least, text in ((90, "reliable"), (70, "usable with caution"), (40, "suspicious"), (-1, "not fit for production")) if score >= least)


def downsample(items: list, most: int = 600) -> list:
    n = len(items)
    return items if n <= most else [items[int(i * (n - 1) / (most - 1) + 0.5)] for i in range(most)]


def price_line(closes: list[float], width: int = 800, height: int = 200) -> str:
    points = downsample(closes)
    if len(points) < 2:
        return ""
    low, high = min(points), max(points)
    span = high - low or 1
    xy = " ".join(f"{i * width / (len(points) - 1):.1f},{height - (c - low) * height / span:.1f}" for i, c in enumerate(points))
    return f'<svg viewBox="0 0 {width} {height}" role="img"><polyline fill="none" stroke="currentColor" points="{xy}"/></svg>'


def overlay(days: list[tuple[str, float, float]], sources: tuple[str, str], findings: list[dict], gap: float = 0.02, width: int = 800, height: int = 200) -> str:
    """Both closes over the shared days, on one scale; days that are more than gap apart are marked, and lead to the day's worst finding.

    days: (day, close of a, close of b), in order. Long series are thinned; marks and extremes are those of the days drawn.
    """
    days = downsample([x for x in days if all(isinstance(v, (int, float)) and isfinite(v) for v in x[1:])])
    if not days:
        return ""
    low, high = min(min(x[1:]) for x in days), max(max(x[1:]) for x in days)
    across = lambda i: i * width / (len(days) - 1) if len(days) > 1 else width / 2
    up = lambda v: height - (v - low) * height / ((high - low) or 1)
    shapes, marks = [], []
    for side in (1, 2):
        xy = " ".join(f"{across(i):.1f},{up(x[side]):.1f}" for i, x in enumerate(days))
        one = f'<circle class="s{side}" cx="{across(0):.1f}" cy="{up(days[0][side]):.1f}" r="3"/>'
        shapes.append(f'<polyline class="s{side}" fill="none" points="{xy}"/>' if len(days) > 1 else one)
    card: dict[str, int] = {}
    for i, f in enumerate(findings):  # the worst comes first
        card.setdefault(f.get("where_date"), i)
    for i, (day, a, b) in enumerate(days):
        apart = abs(a - b) / max(a, b) if max(a, b) > 0 else 0
        if apart > gap:
            dot = f'<circle class="mark" cx="{across(i):.1f}" cy="{(up(a) + up(b)) / 2:.1f}" r="4"><title>{esc(day)}: {a:.2f} and {b:.2f}, {apart:.1%} apart</title></circle>'
            marks.append(f'<a href="#f{card[day]}">{dot}</a>' if day in card else dot)
    told = f"{len(days)} shared days, {len(marks)} more than {gap:.0%} apart"
    legend = "".join(f'<li class="s{k}">{esc(name)}: {min(x[k] for x in days):.2f} to {max(x[k] for x in days):.2f}</li>' for k, name in enumerate(sources, 1))
    return f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="{told}">{"".join(shapes)}{"".join(marks)}</svg><ul>{legend}<li>{told}</li></ul>'


def _links(urls: list[str] | None) -> str:
    """A list of the links that are http or https."""
    items = [f'<li><a href="{esc(u)}" rel="noopener noreferrer">{esc(u)}</a></li>' for u in urls or () if safe_href(u)]
    return f"<ul>{''.join(items)}</ul>" if items else ""


def page(title: str, score: int, summary: dict[str, int], findings: list[dict], closes: list[float] = (), chart: str = "") -> str:
    """findings: dicts with rule, severity, explanation, occurrences, evidence (JSON) and references (links), in order; chart: overlay() of a comparison."""
    cards = "".join(f'<article id="f{i}" class="{esc(f["severity"])}"><h3>{esc(f["rule"])}</h3><p>{esc(f["explanation"])}</p><pre>{esc(f.get("evidence") or "")}</pre>{_links(f.get("references"))}</article>' for i, f in enumerate(findings))
    steps, left = [], 100
    for f in findings:
        left = max(0, left - {"critical": 40, "warning": 15, "info": 5}[f["severity"]])
        steps.append(f"<li>{esc(f['rule'])}: {left}</li>")
    blob = json.dumps({"score": score, "findings": findings}, default=str).replace("<", "\\u003c")
    counts = ", ".join(f"{n} {esc(s)}" for s, n in summary.items())
    return f"""<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'"><title>{esc(title)}</title><style>{_STYLE}</style></head>
<body><h1>{esc(title)}</h1><p><strong>{score}</strong> of 100: {band(score)}; {counts}</p><ol>{"".join(steps)}</ol>{chart or price_line(list(closes))}{cards}<script type="application/json" id="data">{blob}</script></body></html>"""

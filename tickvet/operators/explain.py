"""Explanations that carry the evidence: a text of sentences for each rule, filled in from a finding's evidence.

A text's sentences are divided by `|`. `{name}` is the evidence's value as it stands, `{name:n}` a number's shortest text,
`{name:2}` the number with two digits, `{name:%2}` a hundred times it with two digits, `{p.name}` a parameter of the rule. A
sentence that names a missing value is left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickvet.functions.numbers import fixed, fixed_text, let, number_text
from tickvet.operators.catalog import Rule

TEXTS = {
    "SPLIT_NOT_ADJUSTED": "the close went from {previous_close:n} to {close:n} ({return:%2} %), as a {hypothesized_ratio} split leaves it, and none is on record within {p.splitWindowDays} days|volume was {volume_ratio:2} times the bar before",
    "RETURN_SPIKE": "a return of {return:%2} % has the modified z-score {modified_zscore:2}, the bound is {p.zscoreThreshold}",
    "PRICE_SPIKE_INTRADAY": "the close {close:n} is {deviation_pct:2} % off the median {neighborhood_median:4} around it|the next close is {reverted_to:n}",
    "PRICE_NONPOSITIVE": "{field} is {value:n}",
    "INSUFFICIENT_DATA": "{bars:n} bars where {min_bars:n} are needed",
    "OHLC_INCONSISTENT": "{check} with open {open:n}, high {high:n}, low {low:n}, close {close:n}",
    "VOLUME_NEGATIVE": "volume is {volume:n}",
    "ZERO_VOLUME_MOVED": "high {high:n} and low {low:n} without volume",
    "TS_DUPLICATED": "{count:n} bars share it",
    "TS_UNORDERED": "{current} stands after {previous}",
    "BAR_MISSING": "{gap_weekdays:n} weekdays without a bar between {from} and {to}",
    "STALE_PRICE": "close {close:n} for {sessions:n} sessions, {from} to {to}",
    "CURRENCY_SCALE_SUSPECT": "about {scale_factor:1} times {direction}, median close {median_before:4} before and {median_after:4} from then on",
    "DIV_DUPLICATED": "{amount:n} on {first_exDate} and on {duplicate_exDate}, {days_apart:n} days apart",
    "EXDATE_AFTER_PAYDATE": "{amount:n} is paid on {payDate}, before the ex-date {exDate}",
    "EXDATE_MISPLACED": "a drop of {expected_drop_pct:2} % is due and {actual_drop_pct:2} % is seen|one that fits is seen on {matched_date}",
    "DIV_NOT_ADJUSTED": "{dividend_amount:n} calls for an adjustment of {expected_adjustment_pct:3} %, the median factor {median_factor_before:6} before it makes {observed_adjustment_pct:3} %",
    "DIV_SCALE_100X": "{amount:n} is {single_yield_pct:%2} % of the previous close {prev_close:n}, the bound is {p.maxSingleYieldPct}|a hundredth of it is {hypothesized_amount:n}",
    "DIV_YIELD_IMPOSSIBLE": "regular dividends of a year sum to {ttm_dividends:4}, {ttm_yield_pct:%2} % of the last close {close:n}",
    "DIV_SPECIAL_MISCLASSIFIED": "{amount:n} is {ratio:2} times the median {peer_median:4} of the other regular ones",
    "SPLIT_RATIO_IMPROBABLE": "{numerator:n} for {denominator:n} is {reason}",
    "CORPORATE_ACTION_MISSING_FROM_FACTOR": "the median factor of {bars_examined:n} bars after all actions is {median_factor:6}|{registered_dividends:n} dividends and {registered_splits:n} splits are on record",
    "MARKETCAP_MISMATCH": "{marketCap:n} on record, {implied_market_cap:2} from shares and close, {deviation_pct:2} % apart",
    "PE_EPS_INCOMPATIBLE": "P/E {pe:n} with EPS {eps:n} and close {close:n}, which make {implied_pe:2}",
    "PAYOUT_IMPOSSIBLE": "the ratio is {payout_ratio:n}, the bounds are 0 and {p.maxPayout}",
    "FUNDAMENTALS_SIGN_VALIDITY": "{field} is {value:n}",
    "CURRENCY_SUSPECT": "labelled {currency} at a median close of {median_close:4}",
    "SYMBOL_MAPPING_SUSPECT": "ISIN {isin}|listed on {exchange} of {exchange_country}",
    "DIVIDEND_FX_MISMATCH": "paid in {dividend_currency}, quoted in {series_currency}",
    "SYMBOL_MISMATCH": "{a} and {b}",
    "INSUFFICIENT_OVERLAP": "{shared_dates:n} dates in common where {min_shared_dates:n} are needed, {only_in_a:n} only in A, {only_in_b:n} only in B",
    "CLOSE_DIVERGENCE": "the median of {shared_dates:n} dates is {median_divergence:%3} %, the most {worst_divergence:%3} %",
    "PRICE_DATE_MISMATCH": "{close_a:n} in A and {close_b:n} in B, {divergence:%3} % apart",
    "DIVIDEND_MISMATCH": "{kind}, amount {value:n}|the other source has {other:n}",
    "SPLIT_MISMATCH": "{kind}, ratio {value:6}|the other source has {other:6}",
    "VOLUME_DIVERGENCE": "the median ratio of {dates:n} dates is {median_ratio:3}, the most {worst_ratio:3}",
}
_FIELD = re.compile(r"\{([\w.]+)(?::(%?)(\d|n))?\}")


def sentences(rule: Rule, params: Mapping[str, float]) -> list[list[tuple]]:
    """A rule's sentences as parts (text before, evidence name or None, kind): kind None: as it stands, -1: shortest, else (times, digits)."""
    own = {**rule.params, **params}
    out = []
    for sentence in TEXTS.get(rule.id, "").split("|"):
        parts, at, before = [], 0, ""
        for m in _FIELD.finditer(sentence):
            before, at = before + sentence[at : m.start()], m.end()
            name, percent, digits = m.groups()
            if name.startswith("p."):
                before += f"{own[name[2:]]:.12g}"
                continue
            kind = None if digits is None else -1 if digits == "n" else (100.0 if percent else 1.0, int(digits))
            parts.append((before, name, kind))
            before = ""
        out.append([*parts, (before + sentence[at:], None, None)])
    return out


def told(rule: Column, evidence: Column, rules: Mapping[str, Rule], params: Mapping[str, Mapping[str, float]]) -> Column:
    """The filled-in text of a finding's rule; empty if no sentence has all its values. evidence is a JSON object."""

    def part(before: str, name: str | None, kind) -> dict:
        times, digits = kind if isinstance(kind, tuple) else (1.0, kind)
        return {"before": before, "name": name, "times": times, "digits": digits}

    # One literal instead of thousands of expressions; the optimizer parses it once.
    told_by = {r.id: [[part(*p) for p in s] for s in sentences(r, params.get(r.id, {}))] for r in rules.values()}
    texts = F.from_json(F.lit(json.dumps(told_by)), "map<string,array<array<struct<before:string,name:string,times:double,digits:int>>>>")

    def filled(p: Column, values: Column) -> Column:
        raw = F.try_element_at(values, p["name"])
        number = raw.try_cast("double")
        value = F.when(p["digits"].isNull(), raw).when(p["digits"] < 0, number_text(number)).otherwise(fixed_text(number * p["times"], p["digits"]))
        return F.concat(p["before"], F.when(p["name"].isNull(), "").otherwise(value))

    def joined(values: Column) -> Column:
        whole = lambda sentence: F.aggregate(sentence, F.lit(""), lambda a, p: F.concat(a, filled(p, values)))  # noqa: E731  null if a value is
        return F.array_join(F.filter(F.transform(F.try_element_at(texts, rule), whole), lambda s: s.isNotNull()), "; ")

    return F.coalesce(let(F.from_json(evidence, "map<string,string>"), joined), F.lit(""))


def evidence_text(evidence: Column) -> Column:
    """`name=value` of all evidence in the order of names, numbers to six digits: to compare by."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.when(e["value"].try_cast("double").isNotNull(), number_text(fixed(e["value"].try_cast("double"), 6))), e["value"]))
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(evidence, "map<string,string>"))), entry), ", ")

"""Configuration from a JSON file, checked strictly."""

from __future__ import annotations

import json
import math
import os

from tickvet.operators.catalog import CHECK_RULES, COMPARE_RULES, SEVERITIES
from tickvet.operators.engine import Config, Override


class ConfigError(ValueError):
    pass


def _overrides(given, rules, where) -> dict[str, Override]:
    if not isinstance(given, dict):
        raise ConfigError(f"{where} must be an object")
    out = {}
    for id_, o in given.items():
        if id_ not in rules:
            raise ConfigError(f"{where}: unknown rule {id_}; known: {', '.join(rules)}")
        if not isinstance(o, dict) or set(o) - {"enabled", "severity", "params"}:
            raise ConfigError(f"{where}.{id_}: only enabled, severity and params may be set")
        if o.get("severity", "info") not in SEVERITIES or not isinstance(o.get("enabled", True), bool):
            raise ConfigError(f"{where}.{id_}: severity must be one of {', '.join(SEVERITIES)}, enabled true or false")
        params = o.get("params", {})
        for k, v in params.items():
            if k not in rules[id_].params:
                raise ConfigError(f"{where}.{id_}: unknown parameter {k}; known: {', '.join(rules[id_].params) or 'none'}")
            if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
                raise ConfigError(f"{where}.{id_}.{k}: must be a finite number")
        out[id_] = Override(o.get("enabled", True), o.get("severity"), params)
    return out


def parse(data) -> Config:
    if not isinstance(data, dict) or set(data) - {"rules", "compareRules"}:
        raise ConfigError("only rules and compareRules may be set")
    return Config(_overrides(data.get("rules", {}), CHECK_RULES, "rules"), _overrides(data.get("compareRules", {}), COMPARE_RULES, "compareRules"))


def load(path: str | None = None, default: str = "tickvet.config.json") -> Config:
    """A named file must exist; without a name a missing default is an empty configuration."""
    if path is None and not os.path.exists(default):
        return Config()
    try:
        with open(path or default, encoding="utf-8") as f:
            return parse(json.load(f))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"{path or default}: {e}") from e

"""The catalog of rules: identity, default severity, data-quality dimension and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

SEVERITIES = ("critical", "warning", "info")
ACTIONS = {"critical": "block", "warning": "flag", "info": "review"}
PENALTIES = {"critical": 40, "warning": 15, "info": 5}


@dataclass(frozen=True)
class Rule:
    id: str
    block: str
    severity: str
    dimension: str
    description: str
    params: dict[str, float] = field(default_factory=dict)

    @property
    def rank(self) -> tuple:
        """Order of ids in which `_` stands before letters, as in a dictionary."""
        return tuple(-1 if c == "_" else ord(c) for c in self.id)


def _r(id_, block, severity, dimension, description, **params):
    return Rule(id_, block, severity, dimension, description, params)


CHECK_RULES = {r.id: r for r in (
    _r("SPLIT_NOT_ADJUSTED", "price", "critical", "accuracy", "a jump between closes that looks like a split without one on record", tolerance=0.05, splitWindowDays=3),
    _r("RETURN_SPIKE", "price", "warning", "accuracy", "a return far outside the series' own distribution", minReturns=10, minReturnPct=0.04, zscoreThreshold=3.5, splitTolerance=0.05),
    _r("PRICE_SPIKE_INTRADAY", "price", "critical", "accuracy", "a close far from its neighbourhood that reverts at once", window=5, theta=3, minDeviationPct=0.1),
    _r("PRICE_NONPOSITIVE", "price", "critical", "validity", "a price that is zero, negative or not a number"),
    _r("INSUFFICIENT_DATA", "price", "warning", "completeness", "too few bars to judge", minBars=10),
    _r("OHLC_INCONSISTENT", "price", "critical", "validity", "open, high, low and close contradict each other"),
    _r("VOLUME_NEGATIVE", "price", "critical", "validity", "a volume below zero or not a number"),
    _r("ZERO_VOLUME_MOVED", "price", "warning", "consistency", "the price moved within a bar without volume"),
    _r("TS_DUPLICATED", "price", "critical", "uniqueness", "several bars of one time"),
    _r("TS_UNORDERED", "price", "warning", "consistency", "a bar earlier than the one before it"),
    _r("BAR_MISSING", "price", "warning", "completeness", "a gap of many weekdays", minMissingWeekdays=5),
    _r("STALE_PRICE", "price", "warning", "timeliness", "the same close for several sessions with trade", consecutiveSessions=3),
    _r("CURRENCY_SCALE_SUSPECT", "price", "warning", "consistency", "the level shifts by about a hundred and stays", scaleTolerance=0.2, minRunSessions=3),
    _r("DIV_DUPLICATED", "corporate", "warning", "uniqueness", "the same dividend twice within days", windowDays=7, amountTolerancePct=0.001),
    _r("EXDATE_AFTER_PAYDATE", "corporate", "warning", "validity", "paid before the ex-date", largeDividendPct=0.2),
    _r("EXDATE_MISPLACED", "corporate", "warning", "consistency", "the drop of a dividend came later than its ex-date", minExpectedDropPct=0.02, minMatchRatio=0.5, maxMatchRatio=2, searchWindowSessions=30),
    _r("DIV_NOT_ADJUSTED", "corporate", "warning", "consistency", "adjustment factors before a dividend ignore it", minAdjustmentPct=0.001, minBarsBefore=3, underAdjustmentRatio=0.5),
    _r("DIV_SCALE_100X", "corporate", "warning", "accuracy", "one dividend is out of scale with the price", maxSingleYieldPct=0.25),
    _r("DIV_YIELD_IMPOSSIBLE", "corporate", "warning", "accuracy", "a year's dividends are out of scale with the price", maxAnnualYieldPct=0.2),
    _r("DIV_SPECIAL_MISCLASSIFIED", "corporate", "info", "consistency", "an isolated, outsized dividend tagged regular", minPeers=4, magnitudeRatio=5, isolationDays=90),
    _r("SPLIT_RATIO_IMPROBABLE", "corporate", "warning", "validity", "a split ratio of one, nearly one, or extreme", nearOneTolerance=0.05, extremeRatio=20),
    _r("CORPORATE_ACTION_MISSING_FROM_FACTOR", "corporate", "warning", "consistency", "adjustment factors imply an action that is not on record", minBarsAfter=3, factorDeviationTolerance=0.002),
    _r("MARKETCAP_MISMATCH", "fundamentals", "warning", "accuracy", "market cap is not shares times close", tolerancePct=0.05),
    _r("PE_EPS_INCOMPATIBLE", "fundamentals", "warning", "accuracy", "P/E does not agree with close and EPS", tolerancePct=0.1),
    _r("PAYOUT_IMPOSSIBLE", "fundamentals", "warning", "accuracy", "a payout ratio below zero or above a bound", maxPayout=3.0),
    _r("FUNDAMENTALS_SIGN_VALIDITY", "fundamentals", "critical", "validity", "market cap or shares not above zero"),
    _r("CURRENCY_SUSPECT", "metadata", "warning", "consistency", "currency missing, or pence labelled as pounds", penceMagnitudeThreshold=500),
    _r("SYMBOL_MAPPING_SUSPECT", "metadata", "warning", "consistency", "ISIN invalid or of another country than the exchange"),
    _r("DIVIDEND_FX_MISMATCH", "metadata", "warning", "consistency", "dividends in another currency than the series"),
)}

COMPARE_RULES = {r.id: r for r in (
    _r("SYMBOL_MISMATCH", "compare", "critical", "consistency", "the two sources name different symbols"),
    _r("INSUFFICIENT_OVERLAP", "compare", "warning", "completeness", "too few dates in common", minSharedDates=5),
    _r("CLOSE_DIVERGENCE", "compare", "warning", "consistency", "closes differ systematically", minSharedDates=10, medianTolerancePct=0.005),
    _r("PRICE_DATE_MISMATCH", "compare", "info", "consistency", "closes differ on single dates", minSharedDates=5, dateTolerancePct=0.02),
    _r("DIVIDEND_MISMATCH", "compare", "warning", "consistency", "dividends missing or different in one source", matchWindowDays=7, amountTolerancePct=0.01),
    _r("SPLIT_MISMATCH", "compare", "warning", "consistency", "splits missing or different in one source", matchWindowDays=7, ratioTolerancePct=0.01),
    _r("VOLUME_DIVERGENCE", "compare", "info", "consistency", "volumes differ systematically", minSharedDates=10, volumeRatioThreshold=2),
)}


def order_of(rules: dict[str, Rule]) -> dict[str, int]:
    return {r.id: i for i, r in enumerate(sorted(rules.values(), key=lambda r: r.rank))}


# The links that a rule's findings carry, in this order. A rule that is not here has none.
REFERENCES = {
    "SPLIT_NOT_ADJUSTED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html", "https://github.com/ranaroussi/yfinance/issues/2002"),
    "RETURN_SPIKE": ("https://statsolvepro.com/outlier-detection-methods/",),
    "PRICE_SPIKE_INTRADAY": (
        "https://www.thestack.technology/nyse-glitch-cause/",
        "https://real-statistics.com/time-series-analysis/stochastic-processes/hampel-filter-outliers/",
        "https://www.finra.org/rules-guidance/rulebooks/finra-rules/11892",
    ),
    "PRICE_NONPOSITIVE": ("https://public.econ.duke.edu/~get/browse/courses/201/spr12/DOWNLOADS/MicroStructure/bhls_kernels_practice_08.pdf",),
    "OHLC_INCONSISTENT": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "VOLUME_NEGATIVE": ("https://public.econ.duke.edu/~get/browse/courses/201/spr12/DOWNLOADS/MicroStructure/bhls_kernels_practice_08.pdf",),
    "ZERO_VOLUME_MOVED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "TS_DUPLICATED": ("https://github.com/ranaroussi/yfinance/issues/902",),
    "TS_UNORDERED": ("https://github.com/ranaroussi/yfinance/issues/902",),
    "BAR_MISSING": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "STALE_PRICE": ("https://eodhd.com/financial-academy/fundamental-analysis-examples/real-time-market-data-reliability-stale-price-detection-rest-fallback-and-websocket-recovery",),
    "CURRENCY_SCALE_SUSPECT": ("https://forum.portfolio-performance.info/t/stock-prices-in-pence-gbx/14270", "https://ranaroussi.github.io/yfinance/advanced/price_repair.html"),
    "DIV_DUPLICATED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "EXDATE_AFTER_PAYDATE": ("https://developers.lseg.com/en/article-catalog/article/workspace-corporate-actions-content-set-guide", "https://www.finra.org/rules-guidance/rulebooks/finra-rules/11140"),
    "EXDATE_MISPLACED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "DIV_NOT_ADJUSTED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "DIV_SCALE_100X": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "DIV_YIELD_IMPOSSIBLE": ("https://quantpedia.com/working-with-high-frequency-tick-data-cleaning-the-data/",),
    "DIV_SPECIAL_MISCLASSIFIED": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "SPLIT_RATIO_IMPROBABLE": (
        "https://www.ge.com/news/press-releases/ge-announces-effective-date-for-reverse-stock-split",
        "https://www.barrons.com/articles/ge-announced-tons-wednesday-this-was-the-real-bombshell-51615389095",
        "https://www.nasdaqtrader.com/TraderNews.aspx?id=ECA2018-98",
    ),
    "CORPORATE_ACTION_MISSING_FROM_FACTOR": ("https://ranaroussi.github.io/yfinance/advanced/price_repair.html",),
    "MARKETCAP_MISMATCH": ("https://quant.stackexchange.com/questions/23085/correct-alphabet-google-market-cap-calculation",),
    "PE_EPS_INCOMPATIBLE": ("https://www.asimplemodel.com/insights/extremely-sloppy-and-dubious-sell-side-research",),
    "PAYOUT_IMPOSSIBLE": ("https://www.asimplemodel.com/insights/extremely-sloppy-and-dubious-sell-side-research",),
    "CURRENCY_SUSPECT": ("https://forum.portfolio-performance.info/t/stock-prices-in-pence-gbx/14270", "https://www.fool.co.uk/investing-basics/why-are-uk-stock-prices-quoted-in-pence-not-pounds/"),
    "SYMBOL_MAPPING_SUSPECT": ("https://www.crucible-research.com/nasdaq-100-historical-constituents", "https://forum.amibroker.com/t/survivorship-bias-why-only-delisting-date/29543"),
    "DIVIDEND_FX_MISMATCH": ("https://forum.portfolio-performance.info/t/stock-prices-in-pence-gbx/14270",),
    "CLOSE_DIVERGENCE": ("https://www.kibot.com/quality/data-comparison.html",),
    "PRICE_DATE_MISMATCH": ("https://www.kibot.com/quality/data-comparison.html",),
    "DIVIDEND_MISMATCH": ("https://github.com/ranaroussi/yfinance/issues/2214",),
    "SPLIT_MISMATCH": ("https://github.com/ranaroussi/yfinance/discussions/2183",),
    "VOLUME_DIVERGENCE": ("https://quant.stackexchange.com/questions/51072/yahoo-finance-volume-vs-sum-of-hourly-bars",),
}

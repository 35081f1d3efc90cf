"""Column helpers: finite guards, robust statistics over arrays, calendars, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# One-day returns that an unadjusted split leaves, in order of preference.
SPLIT_RETURNS = (
    ("2:1", -1 / 2), ("3:1", -2 / 3), ("3:2", -1 / 3), ("4:1", -3 / 4), ("5:1", -4 / 5), ("7:1", -6 / 7), ("10:1", -9 / 10), ("20:1", -19 / 20),
    ("1:2 (reverse)", 1.0), ("1:5 (reverse)", 4.0), ("1:8 (reverse)", 7.0), ("1:10 (reverse)", 9.0), ("1:20 (reverse)", 19.0),
)

# The exchanges that list securities of an ISIN country.
COUNTRY_EXCHANGES = {
    "US": ("NASDAQ", "NYSE", "NYSE AMERICAN", "BATS", "ARCA"), "GB": ("LSE",), "DE": ("XETRA", "FRA"), "FR": ("EPA",), "CH": ("SIX",), "ES": ("BME",),
    "IT": ("BIT",), "NL": ("AMS",), "SE": ("STO",), "JP": ("TSE",), "HK": ("HKEX",), "AU": ("ASX",), "CA": ("TSX",),
}

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite; never null itself."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def positive(c: Column) -> Column:
    return finite(c) & (c > 0)


def to_ms(raw: Column) -> Column:
    """Epoch milliseconds of an ISO date or datetime (UTC where no offset is given); null if it is not one."""
    return F.when(raw.rlike(_ISO), F.unix_millis(raw.try_cast("timestamp")))


def utc_day(ms: Column, raw: Column) -> Column:
    """The UTC day of a parsed time, else the raw text."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), raw)


def middle(values: Column) -> Column:
    """Median of an array without nulls; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def spread(values: Column, center: Column) -> Column:
    """Median absolute deviation of an array."""
    return middle(F.transform(values, lambda x: F.abs(x - center)))


def split_label(ret: Column, tolerance: float) -> Column:
    """The first split ratio whose implied return is within the relative tolerance, with slack for rounding."""
    return F.coalesce(*(F.when(F.abs(ret - r) <= tolerance * abs(r) * (1 + 1e-9), F.lit(label)) for label, r in SPLIT_RETURNS))


def weekdays_between(start_ms: Column, end_ms: Column) -> Column:
    """Mondays to Fridays among start + 1 day, start + 2 days, ... before end; 0 if the order is wrong or a time is missing."""
    n = F.ceil((end_ms - start_ms) / DAY_MS).cast("long") - 1
    first = F.floor(start_ms / DAY_MS).cast("long") + 4  # days since a Monday, of the day after start
    upto = lambda d: F.floor(d / 7) * 5 + F.least(F.pmod(d, F.lit(7)), F.lit(5))  # noqa: E731  weekdays in [0, d)
    return F.when((n >= 1), (upto(first + n) - upto(first)).cast("long")).otherwise(F.lit(0).cast("long"))


def isin_valid(isin: Column) -> Column:
    """Form and Luhn checksum of an ISIN, letters counting 10 to 35."""
    digits = F.array_join(F.transform(F.split(isin, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return isin.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", digits)


def normal_timestamp(value: Column) -> Column:
    """Eight digits that are a date, or ten that are epoch seconds from 1990 to 2100, become an ISO date; all else stays."""
    day = F.try_to_date(value, "yyyyMMdd")
    seconds = value.try_cast("long")
    return (
        F.when(value.rlike(r"^\d{8}$") & day.isNotNull(), F.date_format(day, "yyyy-MM-dd"))
        .when(value.rlike(r"^\d{10}$") & (seconds >= 631_152_000) & (seconds < 4_102_444_800), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))
        .otherwise(value)
    )

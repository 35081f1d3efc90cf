"""Vendor connectors: a registry, and a Python data source with a partition for each symbol."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT_S = 15


class ConnectorError(RuntimeError):
    """A vendor gave no usable answer."""


@dataclass(frozen=True)
class Connector:
    name: str
    url: str
    key: str | None = None  # environment variable that holds the vendor's key

    @property
    def available(self) -> bool:
        return self.key is None or bool(os.environ.get(self.key))


CONNECTORS = {
    "yahoo": Connector("yahoo", "https://query1.finance.yahoo.com/v8/finance/chart/{symbol}?range={range}&interval=1d&events=div,splits"),
    "alphavantage": Connector("alphavantage", "https://www.alphavantage.co/query?function=TIME_SERIES_DAILY_ADJUSTED&symbol={symbol}&outputsize=full&apikey={key}", "ALPHAVANTAGE_API_KEY"),
}


def get_connector(name: str) -> Connector:
    if name not in CONNECTORS:
        raise ConnectorError(f"unknown provider {name}; known: {', '.join(CONNECTORS)}")
    found = CONNECTORS[name]
    if not found.available:
        raise ConnectorError(f"provider {name} needs {found.key} to be set")
    return found


def connector_status() -> list[tuple[str, bool, str | None]]:
    return [(c.name, c.available, c.key) for c in CONNECTORS.values()]


class VendorSource(DataSource):
    """spark.read.format("vendor_daily").option("provider", ...).option("symbols", "A,B").load(): dataset_id, text, error."""

    @classmethod
    def name(cls):
        return "vendor_daily"

    def schema(self):
        return "dataset_id string, text string, error string"

    def reader(self, schema):
        return VendorReader(self.options)


class VendorReader(DataSourceReader):
    def __init__(self, options):
        self.provider = options.get("provider", "yahoo")
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.range = options.get("range", "1y")

    def partitions(self):
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition):
        import urllib.request

        c, symbol = get_connector(self.provider), partition.value
        url = c.url.format(symbol=quote(symbol), range=self.range, key=os.environ.get(c.key or "", ""))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=TIMEOUT_S) as answer:
                yield symbol, answer.read().decode(), None
        except OSError as e:
            yield symbol, None, str(e)

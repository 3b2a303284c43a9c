"""A data source that fetches feeds: ``spark.read.format("feed_bodies")``, one row per address.

A fetch never raises: a failure is a row with an error and no body. Addresses are read in parallel, a
few per partition. ``file:`` addresses serve tests and archives.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values
TIMEOUT_S, MAX_BYTES, PER_PARTITION = 25, 8 * 1024 * 1024, 8
SCHEMA = "url string, http_status string, etag string, modified string, encoding string, body binary, error string"


def fetch(url: str, etag: str | None = None, modified: str | None = None, agent: str = "pressloom") -> tuple:
    """The columns of :data:`SCHEMA` for one address."""
    headers = {"User-Agent": agent, "Accept-Encoding": "gzip, deflate"} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as got:
            return url, str(getattr(got, "status", None) or 200), got.headers.get("ETag"), got.headers.get("Last-Modified"), got.headers.get("Content-Encoding"), got.read(MAX_BYTES), None
    except urllib.error.HTTPError as e:
        return url, str(e.code), None, None, None, None, None if e.code == 304 else f"http {e.code}"
    except Exception as e:  # noqa: BLE001 - whatever happens on the way is that poll's result
        return url, type(e).__name__, None, None, None, None, str(e)[:200]


class _Part(InputPartition):
    def __init__(self, asks: list[dict]):
        self.asks = asks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.asks = json.loads(options.get("requests", "[]")) or [{"url": u} for u in options.get("urls", "").split() if u]
        self.agent = options.get("agent", "pressloom")

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.asks[k : k + PER_PARTITION]) for k in range(0, len(self.asks), PER_PARTITION)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for ask in partition.asks:  # type: ignore[attr-defined]
            yield fetch(ask["url"], ask.get("etag"), ask.get("modified"), self.agent)


class FeedBodies(DataSource):
    """Options: ``urls`` (separated by blanks) or ``requests`` (JSON list of url, etag, modified), ``agent``."""

    @classmethod
    def name(cls) -> str:
        return "feed_bodies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

"""A REST reader: one row for each address, fetched on the executors with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, BACKOFF, TIMEOUT = 4, 0.3, 30
AGAIN = frozenset((500, 502, 504))


#: Characters of an address that stay as they are.
PLAIN = "%/:=&?~#+!$,;'@()*[]"


def answer(url: str, params: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, wait: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """Status and JSON text of an address; '{}' for what is no JSON object or array, status 0 where there was no answer, -1 for an answer that is no JSON. Never raises."""
    url = urllib.parse.quote(url, safe=PLAIN)
    if params:
        url = f"{url}?{urllib.parse.urlencode(params)}"
    status = 0
    for attempt in range(RETRIES + 1):
        try:
            with opener(url, timeout=TIMEOUT) as found:
                if found.status != 200:
                    return found.status, "{}"
                body = found.read().decode()
            return (200, body) if isinstance(json.loads(body), (dict, list)) else (-1, "{}")
        except urllib.error.HTTPError as e:
            status = e.code
            if status not in AGAIN:
                return status, "{}"
        except OSError:
            return 0, "{}"
        except ValueError:
            return -1, "{}"
        if attempt < RETRIES:
            wait(BACKOFF * 2**attempt)
    return status, "{}"


def fetch(url: str, params: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, wait: Callable[[float], None] = time.sleep) -> str:
    """The JSON object or array at an address as text; '{}' for anything else. Never raises."""
    return answer(url, params, opener, wait)[1]


def fetch_all(urls: DataFrame, url: str = "url", get: Callable[[str], str] = fetch) -> DataFrame:
    """url, body: an answer for each row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"url": rows[url], "body": [get(u) for u in rows[url]]})

    return urls.select(url).mapInPandas(each, "url string, body string")


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class RestSource(DataSource):
    """spark.read.format("rest").option("urls", "a b c").load() after spark.dataSource.register(RestSource)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(self.options)


class _RestReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.size = int(options.get("partition_size", "50"))

    def partitions(self):
        return [_Part(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Part([])]

    def read(self, partition):
        for u in partition.urls:
            yield (u, fetch(u))

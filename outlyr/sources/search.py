"""A search service as a Spark source: time ranges of an index, read in slices, page after page.

    search.register(spark)
    spark.read.format("outlyr_search").option("url", "http://host:9200").option("index", "events").load().filter("at >= ... and at < ...")

Bounds on at reach the service as a range of its time field, and a lucene filter (query) goes with them; Spark sees them as
pushed filters. A range is cut into slices of equal time, one a task; a task follows the sort values of its last hit (search_after)
from page to page, so it holds one page, and a task that is lost asks anew. Times are those of the service, in milliseconds; a
moment between two of them is rounded so that no row is lost or added. Requests that fail for a moment are made again.

Options: url, index, time (@timestamp), query, page (1000 hits), slices (8), timeout (30 seconds), headers (JSON, for credentials).
Rows: id, at (NULL where a hit has no time that can be read), payload (JSON text). Hits without the time field are in no range.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, at timestamp, payload string"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
TRIES = 4


@dataclass
class Index:
    """Where hits are, and which."""

    url: str
    index: str
    time: str = "@timestamp"
    query: str | None = None
    page: int = 1000
    timeout: float = 30.0
    headers: str = "{}"

    def ask(self, verb: str, body: dict) -> dict:
        data = json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{self.index}/{verb}", data, {"Content-Type": "application/json", **json.loads(self.headers)})
        for k in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as refused:
                if k + 1 == TRIES or refused.code not in (429, 502, 503, 504):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == TRIES:
                    raise
            time.sleep(0.2 * 2**k)
        raise AssertionError

    def range(self, low: int | None, high: int | None) -> dict:
        """The hits of [low, high) in milliseconds."""
        bounds = {k: v for k, v in (("gte", low), ("lt", high)) if v is not None}
        asked = [{"range": {self.time: {**bounds, "format": "epoch_millis"}}}] if bounds else [{"match_all": {}}]
        return {"bool": {"filter": asked + ([{"query_string": {"query": self.query}}] if self.query else [])}}

    def count(self, low: int | None = None, high: int | None = None) -> int:
        return self.ask("_count", {"query": self.range(low, high)})["count"]

    def ends(self) -> tuple[int, int] | None:
        """The first and the last moment that any hit has."""
        found = self.ask("_search", {"size": 0, "query": self.range(None, None), "aggs": {k: {k: {"field": self.time}} for k in ("min", "max")}})["aggregations"]
        return None if found["min"]["value"] is None else (int(found["min"]["value"]), int(found["max"]["value"]))

    def hits(self, low: int | None, high: int | None) -> Iterator[dict]:
        after = None
        while True:
            body = {"size": self.page, "query": self.range(low, high), "sort": [{self.time: {"order": "asc", "format": "epoch_millis"}}, {"_id": "asc"}]}
            found = self.ask("_search", body | ({"search_after": after} if after else {}))["hits"]["hits"]
            yield from found
            if len(found) < self.page:
                return
            after = found[-1]["sort"]


@dataclass
class Slice(InputPartition):
    low: int | None
    high: int | None


def _millis(moment: datetime) -> float:
    """Milliseconds since 1970; a moment without an offset is one of the machine's time, as Spark gives it to a filter."""
    aware = moment if moment.tzinfo else moment.astimezone()
    return (aware - EPOCH) / timedelta(milliseconds=1)


class Reader(DataSourceReader):
    def __init__(self, index: Index, slices: int):
        self.index, self.slices = index, slices
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("at",) or not isinstance(value, datetime) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            at = _millis(value)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                least = math.floor(at) + 1 if isinstance(f, GreaterThan) else math.ceil(at)
                self.low = least if self.low is None else max(self.low, least)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = math.ceil(at) if isinstance(f, LessThan) else math.floor(at) + 1
                self.high = end if self.high is None else min(self.high, end)

    def partitions(self) -> list[Slice]:
        low, high = self.low, self.high
        if low is None or high is None:
            ends = self.index.ends()
            if ends is None:
                return [Slice(low, high)]
            low, high = ends[0] if low is None else low, ends[1] + 1 if high is None else high
        n = max(1, min(self.slices, high - low))
        cuts = [low + (high - low) * k // n for k in range(n + 1)]
        out = [Slice(a, b) for a, b in zip(cuts, cuts[1:])]
        # What no filter bounds stays open, as hits may come meanwhile.
        out[0].low, out[-1].high = self.low, self.high
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        if part.low is not None and part.high is not None and part.low >= part.high:
            return
        for hit in self.index.hits(part.low, part.high):
            at = hit["sort"][0]
            moment = EPOCH + timedelta(milliseconds=int(at)) if at is not None and abs(int(at)) < 1 << 47 else None
            yield hit["_id"], moment, json.dumps(hit["_source"])


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outlyr_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(index_of(self.options), int(self.options.get("slices", 8)))


def index_of(options: dict) -> Index:
    kinds = {"page": int, "timeout": float}
    return Index(**{k: kinds.get(k, str)(options[k]) for k in ("url", "index", "time", "query", "page", "timeout", "headers") if options.get(k) is not None})


def register(spark: SparkSession) -> None:
    """Names the source in a session, and lets its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)


def window(spark: SparkSession, start: datetime, end: datetime, **options) -> DataFrame:
    """The hits of [start, end), in the order of time: seq, id, at, payload (VARIANT), as Engine and Service learn and score them."""
    from pyspark.sql import functions as F

    register(spark)
    rows = spark.read.format("outlyr_search").options(**options).load().filter((F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end)))
    return rows.orderBy("at", "id").select(F.monotonically_increasing_id().alias("seq"), "id", "at", F.try_parse_json("payload").alias("payload"))

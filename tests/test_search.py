"""The search source against a small service of the same interface on this machine."""

import json
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from outlyr import config
from outlyr.plans.engine import Engine
from outlyr.sources import search

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


class Service(BaseHTTPRequestHandler):
    """An index in memory: ranges of a time field, a filter field:word, sorted pages and counts."""

    docs: list = []
    asked: list = []
    refuse = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        cls = type(self)
        if cls.refuse:
            cls.refuse -= 1
            self.send_response(503)
            self.end_headers()
            return
        cls.asked.append((self.path, body))
        found = list(self.docs)
        for f in body["query"]["bool"]["filter"]:
            for bounds in f.get("range", {}).values():
                found = [d for d in found if bounds.get("gte", -(1 << 60)) <= d[1] < bounds.get("lt", 1 << 60)]
            if "query_string" in f:
                name, word = f["query_string"]["query"].split(":")
                found = [d for d in found if d[2].get(name) == word]
        if self.path.endswith("_count"):
            out = {"count": len(found)}
        elif "aggs" in body:
            out = {"aggregations": {"min": {"value": min((d[1] for d in found), default=None)}, "max": {"value": max((d[1] for d in found), default=None)}}}
        else:
            found = sorted((d[1], d[0], d[2]) for d in found)
            if "search_after" in body:
                found = [d for d in found if list(d[:2]) > body["search_after"]]
            out = {"hits": {"hits": [{"_id": i, "_source": s, "sort": [t, i]} for t, i, s in found[: body["size"]]]}}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def served():
    first = int(START.timestamp() * 1000)
    # Several hits of one moment lie on both sides of a page's end.
    Service.docs = [(f"d{i:03}", first + 60_000 * (i // 5), {"v": i % 7, "type": ["a", "b"][i % 2]}) for i in range(300)]
    Service.asked, Service.refuse = [], 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"url": f"http://127.0.0.1:{server.server_port}", "index": "events"}
    server.shutdown()


def read(spark, options):
    search.register(spark)
    return spark.read.format("outlyr_search").options(**options).load()


def test_every_hit_once(spark, served):
    for more in ({"page": "7", "slices": "5"}, {"page": "1000"}, {"slices": "1", "page": "2"}):
        rows = read(spark, served | more).collect()
        assert sorted(r.id for r in rows) == [f"d{i:03}" for i in range(300)]
    row = next(r for r in rows if r.id == "d010")
    assert json.loads(row.payload) == {"v": 3, "type": "a"} and row.at.astimezone(timezone.utc) == START + timedelta(minutes=2)


def test_ranges_are_pushed(spark, served):
    at = lambda minutes: F.lit(START + timedelta(minutes=minutes))
    for condition, want in (
        ((F.col("at") >= at(10)) & (F.col("at") < at(20)), range(50, 100)),
        ((F.col("at") > at(10)) & (F.col("at") <= at(20)), range(55, 105)),
        (F.col("at") == at(3), range(15, 20)),
        ((F.col("at") >= at(20)) & (F.col("at") < at(10)), []),
        ((F.col("at") >= at(59)) & (F.col("payload").contains("3")), [i for i in range(295, 300) if i % 7 == 3]),
    ):
        Service.asked.clear()
        rows = read(spark, served | {"slices": "3"}).filter(condition)
        assert sorted(r.id for r in rows.collect()) == [f"d{i:03}" for i in want]
        # The service is asked for nothing outside.
        for path, body in Service.asked:
            if path.endswith("_search") and "aggs" not in body:
                bounds = body["query"]["bool"]["filter"][0]["range"]["@timestamp"]
                assert bounds["gte"] >= int(START.timestamp() * 1000)
    plan = read(spark, served).filter((F.col("at") >= at(10)) & (F.col("at") < at(20)))._jdf.queryExecution().executedPlan().toString()
    # What is left to Spark is that a hit has a time at all.
    assert [line.split("Filter", 1)[1].strip().split("#")[0] for line in plan.splitlines() if ") Filter" in line] == ["isnotnull(at"]


def test_lucene_filter_and_count(spark, served):
    assert read(spark, served | {"query": "type:b"}).count() == 150
    index = search.index_of(served | {"query": "type:b"})
    first = int(START.timestamp() * 1000)
    assert index.count() == 150 and index.count(first, first + 60_000) == 2
    Service.docs = []
    assert read(spark, served).count() == 0


def test_requests_that_fail_for_a_moment_are_made_again(served):
    Service.refuse = 2
    assert search.index_of(served).count() == 300
    Service.refuse = 99
    with pytest.raises(Exception, match="503"):
        search.index_of(served).count()


def test_train_and_detect_windows(spark, served):
    raw = {"features": {"f": {"v": "numeric"}}, "cohorts": [{"name": "all", "features_config": "f", "model": {"name": "HalfSpaceTrees", "params": {"window_size": 50}}}]}
    train = search.window(spark, START, START + timedelta(minutes=50), **served)
    detect = search.window(spark, START + timedelta(minutes=50), START + timedelta(minutes=60), **served)
    out = Engine(config.parse(raw)).run(train, detect).collect()
    assert len(out) == 50 and all(r.accepted and r.composite_score is not None for r in out)

"""The wiki source against a server on this machine, and its bucket against a clock of its own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from foliomill.sources import wiki


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append((q, self.headers["User-Agent"]))
            status = 503 if q.get("page") == "down" else 200
            body = {"error": {"code": "missing", "info": "no such page"}} if q.get("page") == "none" else {"parse": {"title": q.get("page"), "text": "é" * 3}}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body, ensure_ascii=False).encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/api.php", asked
    s.shutdown()


def read(spark, endpoint, requests, **options):
    wiki.register(spark)
    return spark.read.format("wiki").options(endpoint=endpoint, requests=json.dumps(requests), **options).load()


def test_source(spark, server):
    endpoint, asked = server
    rows = read(spark, endpoint, [{"action": "parse", "page": f"P{i} & é", "section": None} for i in range(9)], partitions="4", rate="1000")
    assert rows.rdd.getNumPartitions() == 4
    got = rows.select(F.get_json_object("request", "$.page").alias("page"), F.get_json_object("body", "$.parse.title").alias("title"), F.get_json_object("body", "$.parse.text").alias("text")).collect()
    assert sorted(map(tuple, got)) == [(f"P{i} & é", f"P{i} & é", "ééé") for i in range(9)]
    q, agent = asked[0]
    assert q["format"] == "json" and q["formatversion"] == "2" and "section" not in q and agent == wiki.AGENT
    assert read(spark, endpoint, []).count() == 0


@pytest.mark.parametrize(("page", "message"), [("down", "503"), ("none", "no such page")])
def test_errors(spark, server, page, message):
    with pytest.raises(Exception, match=message):
        read(spark, server[0], [{"page": page}]).collect()


def test_bucket():
    """A burst up to the capacity, then the rate; what isn't used adds up to the capacity only."""
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    b = wiki.Bucket(10, 5, lambda: now[0], sleep)
    for _ in range(10):
        b.take()
    assert waits == [] and now[0] == 0
    for _ in range(20):
        b.take()
    assert now[0] == pytest.approx(4.0)
    now[0] += 1000
    for _ in range(10):
        b.take()
    assert now[0] == pytest.approx(1004.0)
    b.take()
    assert now[0] == pytest.approx(1004.2)

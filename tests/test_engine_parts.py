"""Requests over HTTP, pacing, robots delay, storing while crawling, cancelling, versions of the store, the JSON interface."""

import io
import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from crawlspark.config import Config
from crawlspark.crawl import Cancelled, Engine
from crawlspark.manager import Api, Manager, serve
from crawlspark.schema import CRAWLED
from crawlspark.sources.responses import HttpFetcher, TableFetcher, next_slot
from crawlspark.store import Store, crawl_into, progress_lines

TREE = {"/": "/a /b", "/a": "/c /d", "/b": "/e", "/c": "", "/d": "", "/e": "/a"}


@pytest.fixture(scope="module")
def server():
    """A site on this machine that notes when each path was asked for, and with which headers."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((time.time(), self.path, dict(self.headers)))
            known = self.path in TREE or self.path == "/robots.txt"
            body = "".join(f'<a href="{x}">x</a>' for x in TREE.get(self.path, "").split()) if known else ""
            if self.path == "/robots.txt":
                body = "User-agent: *\nDisallow: /e\nCrawl-delay: 0.2"
            elif self.path == "/long":
                body = "x" * 5000
            self.send_response(301 if self.path == "/old" else 200 if known or self.path == "/long" else 404)
            self.send_header("Content-Type", "text/html")
            self.send_header("X-Robots-Tag", "noindex")
            self.send_header("X-Robots-Tag", "otherbot: nofollow")
            if self.path == "/old":
                self.send_header("Location", "/a")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_requests(spark, server):
    base, seen = server
    config = Config(seed=base + "/", delay_ms=0, max_body_bytes=1000, headers={"X-Mine": "1"}, user_agent="me/1")
    urls = [base + p for p in ("/a", "/old", "/gone", "/long")] + ["http://127.0.0.1:1/x"]
    got = {r.url.removeprefix(base): r for r in HttpFetcher(config, "127.0.0.1").fetch(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [got[p].status for p in ("/a", "/old", "/gone")] == [200, 301, 404]
    assert got["/old"].location == "/a" and got["/a"].x_robots_tag == "noindex, otherbot: nofollow"
    assert got["/long"].truncated and got["/long"].size == 1000 and not got["/a"].truncated
    assert got["http://127.0.0.1:1/x"].fetch_error and got["http://127.0.0.1:1/x"].status == 0
    headers = next(h for _, p, h in seen if p == "/a")
    assert headers["X-Mine"] == "1" and headers["User-Agent"] == "me/1" and "text/html" in headers["Accept"]


def test_crawl_over_http_keeps_the_longer_delay(spark, server):
    base, seen = server
    seen.clear()
    config = Config(seed=base + "/", delay_ms=50, concurrency=3)
    got = Engine(spark, config, HttpFetcher(config, "127.0.0.1")).run()
    rows = {r.url.removeprefix(base): r for r in got.pages.collect()}
    assert set(rows) == set(TREE) and rows["/e"].blocked and got.stats.delay_ms == 200
    at = sorted(t for t, p, _ in seen if p != "/robots.txt")
    assert len(at) == 5 and min(b - a for a, b in zip(at, at[1:])) > 0.15


def test_turns():
    for workers in (1, 3, 4):
        last, starts = [-1] * workers, []
        for step in range(30):
            w = (step * 7) % workers
            last[w], start = next_slot(10 + 0.01 * step, 10.0, 0.5, w, workers, last[w])
            assert last[w] % workers == w and start >= 10 + 0.01 * step
            starts.append(start)
        starts.sort()
        assert all(b - a > 0.49 for a, b in zip(starts, starts[1:]))
    assert next_slot(99.0, 10.0, 0.0, 2, 4)[1] == 10.0


def table(spark, delay="", tree=TREE):
    rows = [("https://t.test" + p, 200, "text/html", "".join(f'<a href="{x}">x</a>' for x in to.split()).encode()) for p, to in tree.items()]
    rows.append(("https://t.test/robots.txt", 200, "text/plain", f"User-agent: *\nAllow: /\n{delay}".encode()))
    return TableFetcher(spark.createDataFrame(rows, "url string, status int, content_type string, body binary"))


def test_pages_are_stored_while_the_crawl_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    asked = []
    config = Config(seed="https://t.test/", delay_ms=0)

    def stopped():
        asked.append(store.summarize(1)["total"])
        return False

    out = io.StringIO()
    assert crawl_into(store, config, table(spark, "Crawl-delay: 1.5"), progress_lines(out), stopped) == 1
    assert asked == [1, 3] and store.get_crawl(1)["status"] == "done"
    lines = out.getvalue().splitlines()
    assert lines[0].startswith("[   1] 200  text/html   https://t.test/") and len(lines) == store.pages(1).count()
    with pytest.raises(Cancelled):
        Engine(spark, config, table(spark), stopped=lambda: True).run()
    two = crawl_into(store, config, table(spark), stopped=lambda: True)
    assert store.get_crawl(two)["status"] == "cancelled" and store.pages(two).count() == 1


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    tree = {"/": "/a", "/a": ""}
    c = crawl_into(store, Config(seed="https://t.test/", delay_ms=0), table(spark, tree=tree))
    before = [tuple(r) for r in store.pages(c).orderBy("id").collect()]
    # a write that stops before the control table names it changes nothing
    orphan = store.pages(c).withColumn("title", F.lit("half done"))
    store._write(orphan, c, "pages", __import__("crawlspark.schema", fromlist=["PAGES"]).PAGES, 1, "overwrite")
    assert [tuple(r) for r in store.pages(c).orderBy("id").collect()] == before
    store.compact(c)
    assert [tuple(r) for r in store.pages(c).orderBy("id").collect()] == before and store.get_crawl(c)["pages_version"] == 1
    # what a broken batch left is not read, and its number is not used again
    number = store._claim(c)
    store._write(orphan.limit(1).withColumn("id", F.lit(number << 40) + 1), c, "pages", __import__("crawlspark.schema", fromlist=["PAGES"]).PAGES, 1)
    assert store.pages(c).count() == len(before) and store._claim(c) > number
    with pytest.raises(PermissionError):
        Store(spark, "file:///proc/no/such")


def test_json_interface(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    manager = Manager(store, lambda c: table(spark))
    server = serve(Api(store, manager), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/api"

    def ask(path, method="GET", body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body and body.encode(), method=method)) as r:
                text = r.read().decode()
                return r.status, json.loads(text) if text and r.headers["Content-Type"] == "application/json" else text
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    status, made = ask("/crawls", "POST", '{"seed": "https://t.test/", "delay_ms": 0}')
    assert status == 201 and made["status"] == "running"
    assert manager.wait(made["id"], 120)
    status, got = ask("/crawls/1")
    assert status == 200 and got["crawl"]["status"] == "done" and got["summary"]["total"] == 6 and not got["running"]
    page = ask("/crawls/1/pages?limit=2&offset=1")[1]
    assert (page["limit"], page["offset"], page["total"], len(page["pages"])) == (2, 1, 6, 2)
    assert ask(f"/crawls/1/pages/{page['pages'][0]['id']}")[1]["inlinks_total"] == 2
    assert ask("/crawls/1/report?format=md")[1].startswith("# Informe")
    assert ask("/crawls/1", "DELETE")[0] == 204 and ask("/crawls/1")[0] == 404
    server.shutdown()


def test_schema_has_all_columns_of_a_page():
    assert CRAWLED.fieldNames()[-1] == "links"

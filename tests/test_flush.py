"""Pages come out in slices of a round; counters as the state of a stream that is stopped and goes on."""

import pytest
from pyspark.sql import functions as F

from crawlspark.config import Config
from crawlspark.crawl import Cancelled, run
from crawlspark.sources.shared import Folder
from crawlspark.store import Store, crawl_into
from crawlspark.streaming.ingest import read_counters, running_counters
from tests.test_store_and_crawl import SITE, fetcher, page

WIDE = {"/": (200, page(*(f"/p{i}" for i in range(9))) + page("/n", rel="nofollow"))} | {f"/p{i}": (200, page("/n" if i == 7 else f"/q{i}")) for i in range(9)} | {"/n": (200, ""), "/q0": (200, "")}


def test_slices_of_a_round(spark):
    crawled = lambda **flush: run(spark, Config(seed=SITE + "/", delay_ms=0, follow_nofollow=True), fetcher(spark, WIDE), lambda p: seen.append(p.count()), **flush)
    seen = []
    key = ["url", "depth", "status", "via_nofollow", "error"]
    whole = [tuple(r) for r in crawled().pages.orderBy("seq").select(*key).collect()]
    assert len(seen) == 3
    seen = []
    sliced = crawled(flush_pages=4).pages.orderBy("seq").select(*key).collect()
    assert seen[:4] == [1, 4, 4, 2] and sum(seen) == len(whole)
    assert [tuple(r) for r in sliced] == whole
    assert not {r.url: r.via_nofollow for r in sliced}[SITE + "/n"]  # an earlier page of the wave links to it


def test_the_delay_cuts_slices_and_a_stop_waits_for_one(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    at = []
    stopped = lambda: len(at) >= 2
    f = fetcher(spark, WIDE)
    c = crawl_into(st, Config(seed=SITE + "/", delay_ms=500, use_sitemaps=False), f, lambda p: at.append(st.totals(1)[""]), stopped, flush_seconds=1.5)
    assert at == [1, 4]  # the first pages are there while the round goes on
    assert st.get_crawl(c)["status"] == "cancelled" and st.totals(c)[""] == 4


def test_a_stop_within_a_round(spark):
    n = []
    with pytest.raises(Cancelled):
        run(spark, Config(seed=SITE + "/", delay_ms=0), fetcher(spark, WIDE), n.append, lambda: len(n) >= 2, flush_pages=2)
    assert len(n) == 2


def test_counters_go_on_after_a_restart(spark):
    at = Folder(spark, "running").path
    row = lambda i, crawl, status, depth: (i, crawl, f"u{i}", depth, status, i * 10, False, i % 2 == 0, False, "")
    schema = "id long, crawl_id long, url string, depth int, status int, duration_ms long, blocked boolean, noindex boolean, via_nofollow boolean, error string"
    waves = [[row(1, 1, 200, 0), row(2, 2, 404, 1)], [row(3, 1, 301, 4), row(4, 1, 500, 2)], [row(5, 2, 200, 1), row(6, 3, 200, 9)]]
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        running_counters(spark.readStream.schema(schema).parquet(f"{at}/in"), at, None).awaitTermination()
    got = {r.crawl_id: (r.total, r.status_2xx, r.status_3xx, r.status_4xx, r.status_5xx, r.noindex, r.max_depth, r.duration_sum) for r in read_counters(spark, at).collect()}
    assert got == {1: (3, 1, 1, 0, 1, 1, 4, 80), 2: (2, 1, 0, 1, 0, 1, 1, 70), 3: (1, 1, 0, 0, 0, 1, 9, 60)}
    assert spark.read.parquet(f"{at}/totals").agg(F.count_distinct("batch")).first()[0] == 3

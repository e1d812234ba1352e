"""Scans in order that stay on the executors, links that are read once, and URLs that are not asked for twice."""

from pyspark.sql import functions as F

from crawlspark.operators import pages as P
from crawlspark.sources.shared import Folder
from crawlspark.sources.url_runs import UrlRuns
from crawlspark.store import Store
from crawlspark.streaming.ingest import as_crawled, stream_into

_PAGES = "id long, crawl_id long, url string, status int, blocked boolean"


def _some(spark, ids):
    return spark.createDataFrame([(i, 1, f"https://a.test/{i}", 404 if i % 2 else 200, False) for i in ids], _PAGES)


def test_scan_and_stream(spark, monkeypatch):
    asked = []
    any_of = UrlRuns.any_of
    monkeypatch.setattr(UrlRuns, "any_of", lambda self, keys, n: asked.append(n) or any_of(self, keys, n))
    work = Folder(spark, "scan-test")
    s = Store(spark, f"{work.path}/store")
    c = s.create_crawl("https://a.test/")
    stream_into(spark, s, c, _some(spark, range(60)), work)
    assert asked == []  # unseen() had told what is new
    got = s.scan(c, "url").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 61))
    assert [r.id for r in got] == sorted(r.id for r in s.pages(c).collect())
    seen = []
    s.for_each_page(c, lambda r: seen.append(r.url))
    assert seen == [r.url for r in got]
    try:  # who does not say so is still held against the crawl
        s.add_pages(c, as_crawled(_some(spark, [3])))
        raise AssertionError("a stored URL was added again")
    except ValueError:
        pass


def test_links_are_read_once(spark):
    pages = _some(spark, range(6))
    folder = Folder(spark, "links-test")
    rows = [(10 + i, 1, i % 4, f"https://a.test/{1 + i % 2}") for i in range(12)] + [(5, 1, 99, "https://a.test/1")]
    links = folder.save(spark.createDataFrame(rows, "id long, crawl_id long, from_page_id long, to_url string"), "links")
    got = P.broken_with_referrers(pages, links)
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
    assert {r.url[-1]: (r.referrers_count, [u[-1] for u in r.referrers]) for r in got.collect()} == {"1": (7, ["0", "2"]), "3": (0, []), "5": (0, [])}
    assert P.broken_with_referrers(pages, links.where(F.col("id") > 5)).where("url like '%/1'").first().referrers_count == 6

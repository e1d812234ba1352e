import io

import pytest

from crawlspark import cli
from crawlspark.config import Config
from crawlspark.crawl import run
from crawlspark.schema import CRAWLED
from crawlspark.sources.responses import TableFetcher, connection_target
from crawlspark.store import NotFound, Store, crawl_into

SITE = "https://s.test"


def fetcher(spark, site: dict, robots=(404, "")):
    """site: path or URL -> (status, html or location, [content type])."""
    rows = [(f"{SITE}/robots.txt", robots[0], "text/plain", "", robots[1].encode())]
    for path, (status, what, *rest) in site.items():
        moved = 300 <= status < 400
        rows.append((path if "://" in path else SITE + path, status, rest[0] if rest else "text/html", what if moved else "", b"" if moved else what if isinstance(what, bytes) else what.encode()))
    return TableFetcher(spark.createDataFrame(rows, "url string, status int, content_type string, location string, body binary"))


def page(*hrefs, rel=""):
    return "<title>t</title>" + "".join(f'<a href="{h}" rel="{rel}">x</a>' for h in hrefs)


def crawl(spark, site, robots=(404, ""), **settings):
    c = run(spark, Config(seed=SITE + "/", delay_ms=0, **settings), fetcher(spark, site, robots))
    rows = [r.asDict() for r in c.pages.orderBy("seq").collect()]
    return [r["url"].removeprefix(SITE) for r in rows], {r["url"].removeprefix(SITE): r for r in rows}, c.stats


FIVE = {"/": (200, page("/a", "/b")), "/a": (200, page("/c", "/")), "/b": (200, page("/d", "/c")), "/c": (200, page()), "/d": (200, page("/b"))}


def test_breadth_first(spark):
    order, rows, stats = crawl(spark, FIVE)
    assert order == ["/", "/a", "/b", "/c", "/d"]
    assert [rows[u]["depth"] for u in order] == [0, 1, 1, 2, 2]
    assert (stats.fetched, stats.queued, stats.final_host) == (5, 0, "s.test")


def test_limits(spark):
    order, _, stats = crawl(spark, FIVE, max_pages=2)
    assert order == ["/", "/a"] and stats.queued == 2
    order, _, stats = crawl(spark, FIVE, max_depth=1)
    assert order == ["/", "/a", "/b"] and stats.queued == 0


def test_robots(spark):
    order, rows, stats = crawl(spark, FIVE, (200, "User-agent: *\nDisallow: /a"))
    assert rows["/a"]["blocked"] and rows["/a"]["status"] == 0 and "/c" in order and stats.blocked == 1
    order, rows, stats = crawl(spark, FIVE, (503, "x"))
    assert order == ["/"] and rows["/"]["blocked"] and rows["/"]["error"] == "robots.txt: HTTP 503"
    order, _, _ = crawl(spark, FIVE, (503, "x"), ignore_robots=True)
    assert len(order) == 5


def test_missing_pages_and_errors(spark):
    order, rows, stats = crawl(spark, {"/": (200, page("/gone", "/none")), "/gone": (404, page("/x")), "/x": (200, "")})
    assert order == ["/", "/gone", "/none", "/x"]
    assert rows["/none"]["error"] and stats.errors == 1 and stats.fetched == 4


def test_redirects(spark):
    order, rows, _ = crawl(spark, {"/": (301, "/home"), "/home": (200, page("/m", "/n")), "/m": (302, "/t"), "/n": (200, ""), "/t": (200, "")})
    assert order == ["/", "/home", "/m", "/n", "/t"]
    assert rows["/m"]["redirect_to"] == SITE + "/t" and rows["/t"]["depth"] == 1
    order, rows, stats = crawl(spark, {"/": (301, "https://other.test/"), "https://other.test/robots.txt": (404, ""), "https://other.test/": (200, page("/q")), "https://other.test/q": (200, "")})
    assert order == ["/", "https://other.test/", "https://other.test/q"] and stats.final_host == "other.test"
    order, _, _ = crawl(spark, {"/": (301, "/a"), "/a": (301, "/")})
    assert order == ["/", "/a"]


def test_nofollow(spark):
    site = {"/": (200, page("/n", rel="nofollow") + page("/a")), "/n": (200, ""), "/a": (200, page("/n"))}
    assert "/n" in crawl(spark, site)[0]
    _, rows, stats = crawl(spark, site, follow_nofollow=True)
    assert rows["/n"]["via_nofollow"] and stats.via_nofollow == 1
    site["/a"] = (200, "")
    assert "/n" not in crawl(spark, site)[0]


def test_sitemap(spark):
    import gzip

    site = {"/": (200, page()), "/sm.xml": (200, f"<sitemapindex><sitemap><loc>{SITE}/u.xml.gz</loc></sitemap></sitemapindex>"), "/u.xml.gz": (200, gzip.compress(f"<urlset><url><loc>{SITE}/hidden</loc></url><url><loc>https://o.test/</loc></url></urlset>".encode())), "/hidden": (200, "")}
    order, _, stats = crawl(spark, site, (200, f"Sitemap: {SITE}/sm.xml"))
    assert order == ["/", "/hidden"] and stats.sitemaps == 2


def test_origin():
    assert connection_target("https://www.s.test/x", "s.test", "10.0.0.1") == ("10.0.0.1", 443)
    assert connection_target("https://o.test/x", "s.test", "10.0.0.1") is None


def batch(spark, *pages):
    blank = {f.name: {"string": "", "boolean": False}.get(f.dataType.simpleString(), [] if f.name == "links" else None if f.name == "fetched_at" else 0) for f in CRAWLED.fields}
    return spark.createDataFrame([blank | {"seq": i, **p} for i, p in enumerate(pages)], CRAWLED)


def link(url, nofollow=False):
    return {"url": url, "text": "x", "nofollow": nofollow, "in_scope": True}


def test_store(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(NotFound):
        st.get_crawl(1)
    c = st.create_crawl(SITE)
    st.add_pages(c, batch(spark, {"url": "u1", "status": 200, "title": "Hola 100%", "duration_ms": 10, "content_type": "text/html", "links": [link("u2"), link("u3", True), link("u2")]}, {"url": "u2", "status": 404, "duration_ms": 31}, {"url": "u3", "status": 200, "via_nofollow": True}, {"url": "u4", "blocked": True}, {"url": "u5", "error": "EOF"}))
    with pytest.raises(ValueError):
        st.add_pages(c, batch(spark, {"url": "u6"}, {"url": "u2"}))
    with pytest.raises(ValueError):
        st.add_pages(c, batch(spark, {"url": "u7"}, {"url": "u7"}))
    with pytest.raises(NotFound):
        st.add_pages(99, batch(spark, {"url": "u"}))
    s = st.summarize(c)
    assert (s["total"], s["status_2xx"], s["status_4xx"], s["errors"], s["blocked"], s["via_nofollow"], s["avg_duration_ms"]) == (5, 2, 1, 1, 1, 1, 13)
    assert s["content_types"] == {"text/html": 1}
    assert [(r.url, r.referrers_count) for r in st.broken(c).collect()] == [("u2", 2), ("u5", 0)]
    assert [r.from_url for r in st.referrers(c, ["u2"]).collect()] == ["u1", "u1"]
    rows, total = st.list_pages(c, q="hOLA 100%")
    assert total == 1 and rows.first().url == "u1"
    with pytest.raises(ValueError):
        st.list_pages(c, "6xx")
    first = st.find_page(c, "u1")
    d = st.get_page(c, first["id"])
    assert d["outlinks_total"] == 3 and d["inlinks_total"] == 0
    assert st.recompute_via_nofollow(c) == 0
    st.add_pages(c, batch(spark, {"url": "u8", "status": 200, "links": [link("u3")]}))
    assert st.recompute_via_nofollow(c) == 1 and st.recompute_via_nofollow(c) == 0
    seen = []
    st.for_each_page(c, lambda r: seen.append(r.url))
    assert seen == ["u1", "u2", "u3", "u4", "u5", "u8"]
    again = Store(spark, f"file://{tmp_path}/store")
    assert (again.get_crawl(c)["status"], again.get_crawl(c)["error"]) == ("failed", "interrumpido")
    st.delete_crawl(c)
    assert st.pages(c).count() == 0 and st.list_crawls().count() == 0


def test_cli(spark, tmp_path):
    out = io.StringIO()
    store = ["--store", f"file://{tmp_path}/s"]
    f = fetcher(spark, {"/": (200, page("/two", "/missing", "/no")), "/two": (200, page("/missing")), "/missing": (404, "")}, (200, "User-agent: *\nDisallow: /no"))
    f.responses.write.parquet(f"file://{tmp_path}/responses")
    assert cli.main([*store, "crawl", SITE + "/", "--delay-ms", "0", "--responses", f"file://{tmp_path}/responses", "--json"], spark, out) == 0
    assert '"total": 4' in out.getvalue() and '"blocked": 1' in out.getvalue()
    out = io.StringIO()
    assert cli.main([*store, "broken", "1"], spark, out) == 0
    assert out.getvalue().splitlines() == [f"404  {SITE}/missing  (2)", f"    {SITE}/", f"    {SITE}/two"]
    out = io.StringIO()
    assert cli.main([*store, "report", "1"], spark, out) == 0
    assert out.getvalue().count("\n## ") == 12 and "| BLOQ |" in out.getvalue()
    assert cli.main([*store, "pages", "7"], spark, out) == 1
    assert cli.main([*store, "crawl", "nonsense"], spark, out) == 2
    assert cli.main(["unknown"], spark, out) == 2

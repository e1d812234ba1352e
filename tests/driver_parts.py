"""What runs on the driver alone, as small tables with SQL that says what they must be: settings, addresses, sitemap files, lives of crawls."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from crawlspark.config import Config, split_origin
from crawlspark.operators import pages as P
from crawlspark.plans import site as S
from crawlspark.sources.responses import TableFetcher
from crawlspark.sources.shared import Folder
from crawlspark.store import NotFound, Store

PARTS: dict = {}


def query(name, sql, plain=True):
    return lambda f: PARTS.setdefault(name, (f, sql))


_ALL = lambda sql: S.oracle(sql, follow=True)


@query("store_cursor", _ALL("SELECT url FROM site WHERE status = 0 OR status >= 400"), plain=True)
def _(spark, d):
    """Listings of two filters and the blocked pages, page by page of 50."""
    s = S.stored(spark, d)
    out = []
    for f in ("error", "blocked", "4xx", "5xx"):
        out += P.all_in_pages(lambda limit, offset, f=f: [r.url for r in s.list_pages(1, f, limit=limit, offset=offset)[0].select("url").collect()], 50)
    return spark.createDataFrame([(u,) for u in out], "url string")


_STEPS = [
    "(1, 'created', 'running', '', CAST(1 AS BIGINT), false)",
    "(2, 'batch', 'running', '', CAST({n} AS BIGINT), false)",
    "(3, 'batch again', 'running', '', CAST({n} AS BIGINT), true)",
    "(4, 'robots', 'running', 'User-agent: *', CAST(1 AS BIGINT), false)",
    "(5, 'unknown crawl', '', '', CAST(0 AS BIGINT), true)",
    "(6, 'opened again', 'failed', 'interrumpido', CAST({n} AS BIGINT), false)",
    "(7, 'finished again', 'failed', 'interrumpido', CAST({n} AS BIGINT), false)",
    "(8, 'second', 'done', 'all well', CAST(2 AS BIGINT), false)",
    "(9, 'listed first', 'done', '', CAST(2 AS BIGINT), false)",
    "(10, 'compacted', 'failed', '', CAST({n} AS BIGINT), false)",
    "(11, 'deleted', 'done', '', CAST(0 AS BIGINT), false)",
]


@query("store_life", "SELECT * FROM (VALUES " + ", ".join(_STEPS).replace("{n}", "(SELECT count(*) FROM nation)") + ") t(step, what, status, note, n, refused)", plain=True)
def _(spark, d):
    path = Folder(spark, "life").path
    s, rows = Store(spark, path), []

    def step(what, crawl_id, note="", n=0, refused=False):
        rows.append((len(rows) + 1, what, s.get_crawl(crawl_id)["status"] if crawl_id else "", note, n, refused))

    def refused(f) -> bool:
        try:
            f()
        except (ValueError, NotFound):
            return True
        return False

    one = s.create_crawl("https://a.test/")
    step("created", one, n=s.list_crawls().count())
    batch = S.crawl(spark, d, S.HOST + "/", max_depth=0, ignore_robots=True).pages
    named = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("https://a.test/"), F.col("n_nationkey")).alias("url"))
    batch = named.crossJoin(F.broadcast(batch.drop("seq", "url").limit(1))).select(*batch.columns)
    step("batch", one, n=s.add_pages(one, batch))
    again = refused(lambda: s.add_pages(one, batch.limit(3)))
    step("batch again", one, n=s.pages(one).count(), refused=again)
    s.set_robots(one, "User-agent: *")
    step("robots", one, s.get_crawl(one)["robots_txt"], one)
    step("unknown crawl", 0, refused=refused(lambda: s.set_robots(99, "")) and refused(lambda: s.add_pages(99, batch)) and refused(lambda: s.get_page(one, 99)))
    s = Store(spark, path)  # as after a crash
    step("opened again", one, s.get_crawl(one)["error"], s.summarize(one)["total"])
    s.finish_crawl(one, "done")
    step("finished again", one, s.get_crawl(one)["error"], s.summarize(one)["total"])
    two = s.create_crawl("https://b.test/")
    s.finish_crawl(two, "done", "all well")
    step("second", two, s.get_crawl(two)["error"], two)
    step("listed first", two, n=s.list_crawls().first().id)
    s.compact(one)
    step("compacted", one, n=s.pages(one).count())
    s.delete_crawl(one)
    step("deleted", two, n=s.pages(one).count() + s.links(one).count())
    return spark.createDataFrame(rows, "step int, what string, status string, note string, n long, refused boolean")


@query("manager_life", "SELECT * FROM (VALUES (1, 'refused', 'la semilla es obligatoria; delay_ms no puede ser negativo', false), (2, 'ended', 'done', false), (3, 'cancelled', 'cancelled', false), (4, 'shut down', 'cancelled', false)) t(step, what, status, running)", plain=True)
def _(spark, d):
    import threading

    from crawlspark.manager import Invalid, Manager

    store, rows = Store(spark, Folder(spark, "managed").path), []
    table = TableFetcher(S.responses(spark, d))

    class Held:
        """Answers wait until they are let go."""

        def __init__(self, gate):
            self.gate = gate

        def pace(self, delay_ms):
            pass

        def fetch(self, urls):
            self.gate.wait(120)
            return table.fetch(urls)

    gate = threading.Event()
    m = Manager(store, lambda c: Held(gate))
    try:
        m.start(Config(seed="", delay_ms=-1))
    except Invalid as e:
        rows.append((1, "refused", str(e), bool(m.running())))
    settings = {"seed": S.HOST + "/", "delay_ms": 0, "max_depth": 1, "use_sitemaps": False}
    for step, what in ((2, "ended"), (3, "cancelled"), (4, "shut down")):
        gate.clear()
        i = m.start(Config(**settings))
        if m.running() != [i]:
            raise AssertionError("not listed as running")
        if what == "cancelled":
            m.cancel(i)
        if what == "shut down":
            threading.Timer(0.5, gate.set).start()
            m.shutdown(300)
        gate.set()
        m.wait(i, 300)
        rows.append((step, what, store.get_crawl(i)["status"], m.is_running(i)))
    return spark.createDataFrame(rows, "step int, what string, status string, running boolean")


@query("api_answers", _ALL("""SELECT * FROM (VALUES
  (1, 'GET /api/healthz', 200, 'status'), (2, 'GET /api/crawls', 200, 'crawls'), (3, 'GET /api/crawls/1', 200, 'crawl running summary'), (4, 'GET /api/crawls/9', 404, 'errors: no encontrado'),
  (5, 'GET /api/crawls/1/pages', 200, 'limit offset pages total'), (6, 'GET /api/crawls/1/pages?status=6xx', 400, 'errors: status no válido'), (7, 'GET /api/crawls/1/broken', 200, 'broken limit offset total'),
  (8, 'POST /api/crawls', 400, 'errors: json malformado'), (9, 'PUT /api/crawls', 405, 'errors: método no permitido'), (10, 'POST /api/crawls/1/cancel', 200, 'crawl'), (11, 'GET /api/nothing', 404, 'errors: no encontrado'),
  (12, 'GET /api/crawls/1/report?format=pdf', 400, 'errors: format no válido'), (13, 'GET /api/crawls/1/report', 200, 'report'), (14, 'DELETE /api/crawls/9', 404, 'errors: no encontrado'), (15, 'POST /api/crawls {}', 400, 'errors: la semilla es obligatoria')) t(step, request, status, keys)"""), plain=True)
def _(spark, d):
    from urllib.parse import parse_qsl

    from crawlspark.manager import Api, Manager

    api = Api(S.stored(spark, d), Manager(S.stored(spark, d), lambda c: None))
    asked = ["GET /api/healthz", "GET /api/crawls", "GET /api/crawls/1", "GET /api/crawls/9", "GET /api/crawls/1/pages", "GET /api/crawls/1/pages?status=6xx", "GET /api/crawls/1/broken", "POST /api/crawls", "PUT /api/crawls", "POST /api/crawls/1/cancel", "GET /api/nothing", "GET /api/crawls/1/report?format=pdf", "GET /api/crawls/1/report", "DELETE /api/crawls/9", "POST /api/crawls {}"]
    rows = []
    for i, request in enumerate(asked):
        method, at, *body = request.split(" ")
        path, _, q = at.partition("?")
        status, _, text = api.handle(method, path, dict(parse_qsl(q)), body[0] if body else "nonsense")
        x = json.loads(text)
        rows.append((i + 1, request, status, "errors: " + "; ".join(x["errors"]) if "errors" in x else " ".join(sorted(x))))
    return spark.createDataFrame(rows, "step int, request string, status int, keys string")


def _nations(spark, d):
    return [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int")).orderBy(F.col("n_nationkey")).collect()]


_SEEDS = ["https://a.test/x", "ftp://a.test/", "", "  nonsense "]


@query("config_checks", """SELECT CAST(n_nationkey AS INT) AS k, array_to_string(list_filter([
  CASE n_nationkey % 4 WHEN 2 THEN 'la semilla es obligatoria' WHEN 0 THEN '' ELSE 'la semilla debe ser una URL http o https absoluta' END,
  CASE WHEN n_nationkey % 3 = 0 THEN 'max_pages debe ser mayor que 0' ELSE '' END, CASE WHEN n_nationkey % 5 = 0 THEN 'max_depth no puede ser negativo' ELSE '' END,
  CASE WHEN n_nationkey % 2 = 0 THEN 'concurrency debe ser mayor que 0' ELSE '' END, CASE WHEN n_nationkey % 7 = 0 THEN 'delay_ms no puede ser negativo' ELSE '' END,
  CASE n_nationkey % 3 WHEN 0 THEN 'cabecera no válida: "X Y"' WHEN 1 THEN 'valor de cabecera no válido: "X-A"' ELSE '' END,
  CASE n_nationkey % 4 WHEN 1 THEN 'origin no válido: "10.0.0.999"' WHEN 2 THEN 'origin no válido: "10.0.0.1:0"' ELSE '' END], lambda x: x <> ''), '; ') AS errors FROM nation""", plain=True)
def _(spark, d):
    rows = []
    for k in _nations(spark, d):
        headers = [{"X Y": "v"}, {"X-A": "a\nb"}, {"X-B": "fine"}][k % 3]
        origin = ["10.0.0.1", "10.0.0.999", "10.0.0.1:0", "[::1]:8080"][k % 4]
        c = Config(seed=_SEEDS[k % 4], max_pages=0 if k % 3 == 0 else 5, max_depth=-1 if k % 5 == 0 else 0, concurrency=-(k % 2 == 0) or 1, delay_ms=-1 if k % 7 == 0 else 0, headers=headers, origin=origin)
        rows.append((k, "; ".join(c.validate())))
    return spark.createDataFrame(rows, "k int, errors string")


@query("origins", "SELECT CAST(n_nationkey AS INT) AS k, CASE n_nationkey % 3 WHEN 0 THEN '10.1.0.' || n_nationkey WHEN 1 THEN '::' || n_nationkey ELSE '10.2.0.' || n_nationkey END AS host, CASE n_nationkey % 3 WHEN 1 THEN CAST(8000 + n_nationkey AS VARCHAR) WHEN 2 THEN '80' ELSE '' END AS port FROM nation", plain=True)
def _(spark, d):
    given = lambda k: [f"10.1.0.{k}", f"[::{k}]:{8000 + k}", f"10.2.0.{k}:80"][k % 3]
    return spark.createDataFrame([(k, *split_origin(given(k))) for k in _nations(spark, d)], "k int, host string, port string")


@query("connection_targets", "SELECT CAST(n_nationkey AS INT) AS k, CASE n_nationkey % 4 WHEN 3 THEN '' ELSE '10.0.0.1' END AS address, CASE n_nationkey % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 8080 ELSE 0 END AS port FROM nation", plain=True)
def _(spark, d):
    """The origin stands in for the seed's host and its www twin only."""
    from crawlspark.sources.responses import connection_target

    given = [("https://www.s.test/x", "10.0.0.1"), ("http://s.test/x", "10.0.0.1"), ("https://S.test/x", "10.0.0.1:8080"), ("https://o.s.test/x", "10.0.0.1")]
    return spark.createDataFrame([(k, *(connection_target(given[k % 4][0], "s.test", given[k % 4][1]) or ("", 0))) for k in _nations(spark, d)], "k int, address string, port int")


@query("sitemap_files", "SELECT CAST(n_nationkey AS INT) AS k, CASE n_nationkey % 5 WHEN 0 THEN 'urls: https://a.test/' || n_nationkey || ' ' WHEN 1 THEN 'indexes: https://a.test/' || n_nationkey || '.xml' WHEN 2 THEN 'urls: https://a.test/' || n_nationkey ELSE 'nothing' END AS found FROM nation", plain=True)
def _(spark, d):
    import gzip

    from crawlspark.sources.sitemaps import read_sitemap, unpacked

    rows = []
    for k in _nations(spark, d):
        ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
        body = [f"<urlset {ns}><url><loc> https://a.test/{k}\n</loc></url><url><lastmod>x</lastmod></url></urlset>", f"<sitemapindex><sitemap><loc>https://a.test/{k}.xml</loc></sitemap></sitemapindex>", f"<urlset><url><loc>https://a.test/{k}</loc></url></urlset>", "<urlset><url>", f"<rss><loc>https://a.test/{k}</loc></rss>"][k % 5].encode()
        raw = unpacked(gzip.compress(body) if k % 5 == 2 else body, "https://a.test/s.xml")
        indexes, urls = read_sitemap(raw)
        broken = unpacked(b"\x1f\x8bnonsense", "https://a.test/s.xml")
        rows.append((k, "broken" if broken is not None else "urls: " + " ".join(urls) if urls else "indexes: " + " ".join(indexes) if indexes else "nothing"))
    return spark.createDataFrame(rows, "k int, found string")


@query("config_round_trip", """SELECT CAST(n_nationkey AS INT) AS k, 15 AS n_keys, CASE WHEN n_nationkey % 2 = 0 THEN 500 ELSE CAST(n_nationkey AS INT) END AS max_pages, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 500 END AS delay_ms,
  CASE WHEN n_nationkey % 5 = 0 THEN '{"A":"é"}' ELSE '{}' END AS headers FROM nation""", plain=True)
def _(spark, d):
    rows = []
    for k in _nations(spark, d):
        doc = {"seed": "https://a.test/", "max_pages": 0 if k % 2 == 0 else k, "unknown": 1, "timeout_ms": None} | ({"delay_ms": 0} if k % 3 == 0 else {}) | ({"headers": {"A": "é"}} if k % 5 == 0 else {})
        c = Config.from_json(json.dumps(doc))
        back = json.loads(c.to_json())
        if Config.from_json(c.to_json()) != c:
            raise AssertionError("not the same after a round trip")
        rows.append((k, len(back), back["max_pages"], back["delay_ms"], json.dumps(back["headers"], ensure_ascii=False, separators=(",", ":"))))
    return spark.createDataFrame(rows, "k int, n_keys int, max_pages int, delay_ms int, headers string")


@query("robots_groups", """SELECT CAST(n_nationkey AS INT) AS k, CASE WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END AS rules,
  CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS DOUBLE) / 2 ELSE 0 END AS delay, 2 AS sitemaps, n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0 AS allowed, '' AS reason FROM nation""", plain=True)
def _(spark, d):
    from crawlspark.functions.robots import parse_robots

    rows = []
    for k in _nations(spark, d):
        ours = f"User-agent: Other\nUSER-AGENT : a-crawlspark-b # ours\nDisallow: /x{k % 2}\nAllow:\nDisallow: /*.pdf$\nCrawl-delay: {k / 2}\nCrawl-delay: -1\nAllow: /x0/y\n" if k % 3 == 0 else ""
        everyone = "User-agent: *\nDisallow: /never\n" if k % 3 < 2 else ""
        r = parse_robots(f"Sitemap: https://a.test/1.xml\nDisallow: /before\n{ours}{everyone}User-agent: crawlspark\nUser-agent: z\nDisallow:\nsitemap: https://a.test/2.xml\n" if k % 3 == 0 else f"Sitemap: a\nSitemap:\n{everyone}nonsense\nSitemap: b\n")
        g = r.group("crawlspark")
        rows.append((k, len(g.rules) if g else 0, r.crawl_delay("crawlspark"), len(r.sitemaps), r.allowed("crawlspark", "/x1/z"), r.block_reason()))
    return spark.createDataFrame(rows, "k int, rules int, delay double, sitemaps int, allowed boolean, reason string")


@query("html_base", "SELECT CAST(n_nationkey AS INT) AS k, CASE n_nationkey % 3 WHEN 0 THEN 'https://b.test/dir/' WHEN 1 THEN 'https://a.test/p/sub/' ELSE 'https://a.test/p/' END || 'l' || n_nationkey AS url FROM nation", plain=True)
def _(spark, d):
    from crawlspark.functions.html import parse_html

    rows = []
    for k in _nations(spark, d):
        base = ['<base target="x"><base href=" "><base href="https://B.test/dir/page"><base href="/no">', '<base href="sub/">', ""][k % 3]
        found = parse_html(f'{base}<a href="l{k}">x</a>', "https://a.test/p/page", "a.test", False)
        rows.append((k, found["links"][0]["url"]))
    return spark.createDataFrame(rows, "k int, url string")


@query("durations", """SELECT CAST(n_nationkey AS INT) AS k, CASE WHEN n_nationkey = 0 THEN '0s' WHEN n_nationkey < 5 THEN (n_nationkey * 137) || 'ms'
  WHEN n_nationkey < 10 THEN n_nationkey || '.' || (n_nationkey % 10) || 's' WHEN n_nationkey < 20 THEN n_nationkey || 'm5s' ELSE n_nationkey || 'h0m0s' END AS text, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || ' 00:00:00 UTC' AS day FROM nation""", plain=True)
def _(spark, d):
    from datetime import datetime

    from crawlspark.plans.report import duration_text, time_text

    ms = lambda k: 137 * k if k < 5 else 1000 * k + 100 * (k % 10) if k < 10 else 60_000 * k + 5000 if k < 20 else 3_600_000 * k
    return spark.createDataFrame([(k, duration_text(ms(k)), time_text(datetime(2024, 1, k + 1))) for k in _nations(spark, d)], "k int, text string, day string")


@query("limits_and_ranges", """SELECT CAST(n_nationkey AS INT) AS k, CASE WHEN n_nationkey = 0 THEN 100 ELSE least(n_nationkey * 100, 1000) END AS clamped,
  CASE WHEN n_nationkey = 0 THEN '0' ELSE CASE WHEN n_nationkey * 1000 + 1 < 10000 THEN CAST(n_nationkey * 1000 + 1 AS VARCHAR) ELSE replace(format('{:,}', n_nationkey * 1000 + 1), ',', '.') END || '–' || CASE WHEN least(n_nationkey * 1000 + 100, 20050) < 10000 THEN CAST(least(n_nationkey * 1000 + 100, 20050) AS VARCHAR) ELSE replace(format('{:,}', least(n_nationkey * 1000 + 100, 20050)), ',', '.') END || ' de 20.050' END AS label,
  n_nationkey > 0 AS before, n_nationkey > 0 AND n_nationkey * 1000 + 100 < 20050 AS after FROM nation""", plain=True)
def _(spark, d):
    rows = [(k, P.clamp_limit(k * 100), *P.page_range(k * 1000, 100, 20_050 if k else 0)) for k in _nations(spark, d)]
    return spark.createDataFrame(rows, "k int, clamped long, label string, before boolean, after boolean")


@query("request_slots", "SELECT CAST(n_nationkey AS INT) AS k, CAST(n_nationkey AS INT) AS turn, n_nationkey * 0.25 AS start FROM nation", plain=True)
def _(spark, d):
    """The turns of four workers that are always ready, a quarter of a second apart: no two at once."""
    from crawlspark.sources.responses import next_slot

    n, rows, last = len(_nations(spark, d)), [], [-1] * 4
    while len(rows) < n + 4:
        for w in range(4):
            last[w], start = next_slot(0.0, 0.0, 0.25, w, 4, last[w])
            rows.append((last[w], last[w], start))
    return spark.createDataFrame(sorted(rows)[:n], "k int, turn int, start double").withColumn("start", F.col("start").cast("decimal(12,2)"))


@query("schemas", "SELECT * FROM (VALUES ('pages', 21), ('links', 7), ('crawls', 11), ('responses', 10)) t(name, columns)", plain=True)
def _(spark, d):
    """The fixed schemas: a table of each that holds rows written and read again has no null."""
    from crawlspark.schema import CRAWLS, LINKS, PAGES, RESPONSES

    return spark.createDataFrame([(n, len(s.fields)) for n, s in (("pages", PAGES), ("links", LINKS), ("crawls", CRAWLS), ("responses", RESPONSES))], "name string, columns int")

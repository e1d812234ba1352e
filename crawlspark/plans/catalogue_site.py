"""Queries of the crawl engine and the store over the site of site.py."""

from __future__ import annotations

import io
import json

from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources.shared import Folder
from ..store import Store
from . import site as S
from .catalogue import QUERIES, query
from .views import links, pages

_PAGE = ["url", "depth", "status", "blocked", "via_nofollow", "noindex", "title", "failed"]
_COLS = ", ".join(_PAGE)


def _seen(df):
    return df.withColumn("failed", (F.col("status") == 0) & ~F.col("blocked")).select(*_PAGE)


@query("crawl_site", S.oracle(f"SELECT {_COLS} FROM site"), plain=True)
def _(spark, d):
    return _seen(S.crawl(spark, d).pages)


@query("crawl_site_depth", S.oracle(f"SELECT {_COLS} FROM site", depth=2), plain=True)
def _(spark, d):
    return _seen(S.crawl(spark, d, max_depth=2).pages)


# without redirects pages come in order of k: what is taken ends with the page that uses the budget up
_TAKEN = """, allowed AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM site WHERE kind = 'page' AND NOT blocked),
  last AS (SELECT coalesce(max(k) FILTER (n = 100), (SELECT max(k) FROM reach)) AS k FROM allowed),
  taken AS (SELECT * FROM site WHERE kind = 'page' AND k <= (SELECT k FROM last))"""


@query("crawl_site_budget", S.oracle(f"{_TAKEN} SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS n, {_COLS} FROM taken", redirects=False), plain=True)
def _(spark, d):
    work = Folder(spark, "order")
    got = S.crawl(spark, d, S.HOST + "/", False, max_pages=100, use_sitemaps=False).pages
    return work.numbered(got.withColumn("failed", (F.col("status") == 0) & ~F.col("blocked")), "pages", "seq").select(F.col("n").cast("int"), *_PAGE)


_STATS = "fetched long, blocked long, errors long, queued long, sitemaps long, via_nofollow long, delay_ms long, final_host string, robots_bytes long"


def _stats(spark, crawl):
    s = crawl.stats
    return spark.createDataFrame([(s.fetched, s.blocked, s.errors, s.queued, s.sitemaps, s.via_nofollow, s.delay_ms, s.final_host, len(s.robots_txt.encode()))], _STATS)


_COUNTED = f"count(*) FILTER (NOT blocked) AS fetched, count(*) FILTER (blocked) AS blocked, count(*) FILTER (failed) AS errors"
_REST = f"CAST(2000 AS BIGINT) AS delay_ms, 'shop.test' AS final_host, CAST({len(S.ROBOTS.encode())} AS BIGINT) AS robots_bytes"


@query("crawl_site_stats", S.oracle(f"SELECT {_COUNTED}, CAST(0 AS BIGINT) AS queued, (SELECT count(*) + 1 FROM nation) AS sitemaps, CAST(0 AS BIGINT) AS via_nofollow, {_REST} FROM site"), plain=True)
def _(spark, d):
    return _stats(spark, S.crawl(spark, d))


@query("crawl_site_budget_stats", S.oracle(f"{_TAKEN}, waiting AS (SELECT count(*) AS n FROM reach r WHERE r.k > (SELECT k FROM last) AND r.parent <= (SELECT k FROM last)) SELECT {_COUNTED}, (SELECT n FROM waiting) AS queued, CAST(0 AS BIGINT) AS sitemaps, CAST(0 AS BIGINT) AS via_nofollow, {_REST} FROM taken", redirects=False), plain=True)
def _(spark, d):
    return _stats(spark, S.crawl(spark, d, S.HOST + "/", False, max_pages=100, use_sitemaps=False))


# over the store: crawl 1, nofollow links followed
_ALL = lambda sql: S.oracle(sql, follow=True)


@query("store_pages", _ALL(f"SELECT {_COLS} FROM site"), plain=True)
def _(spark, d):
    return _seen(S.stored(spark, d).pages(1))


# the links of every fetched HTML page: home, elsewhere and the pages below
_LINKS = f""", shown AS (SELECT k, url, kind FROM site WHERE title LIKE 'Page %'),
  out AS (
    SELECT url AS from_url, '{S.HOST}/' AS to_url, 'home' AS text, false AS nofollow, true AS in_scope FROM shown
    UNION ALL SELECT url, concat(CASE WHEN kind = 'start' THEN 'http' ELSE 'https' END, '://elsewhere.test/x'), 'out', false, false FROM shown
    UNION ALL SELECT url, concat('{S.HOST}', {S.path('n.k')}), 'to ' || n.k, n.k % 23 = 5, true FROM shown s JOIN node n ON n.k > 0 AND (n.k - 1) // {S.FANOUT} = s.k)"""


@query("store_links", _ALL(f"{_LINKS} SELECT from_url, to_url, text, nofollow, in_scope FROM out"), plain=True)
def _(spark, d):
    s = S.stored(spark, d)
    return P.inlinks(s.pages(1), s.links(1)).select("from_url", "to_url", "text", "nofollow", "in_scope")


@query("store_summary", _ALL("""SELECT CAST(1 AS BIGINT) AS crawl_id, count(*) AS total, count(*) FILTER (status BETWEEN 200 AND 299) AS status_2xx, count(*) FILTER (status BETWEEN 300 AND 399) AS status_3xx,
  count(*) FILTER (status BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (status BETWEEN 500 AND 599) AS status_5xx, count(*) FILTER (failed) AS errors, count(*) FILTER (blocked) AS blocked,
  count(*) FILTER (noindex) AS noindex, count(*) FILTER (via_nofollow) AS via_nofollow, max(depth) AS max_depth,
  CAST(sum(CASE WHEN status = 0 OR kind = 'start' THEN 0 WHEN kind = 'hidden' THEN 1 ELSE k + 5 END) AS BIGINT) // count(*) FILTER (status > 0) AS avg_duration_ms FROM site"""), plain=True)
def _(spark, d):
    return S.stored(spark, d).summary()


@query("store_content_types", _ALL("SELECT CAST(1 AS BIGINT) AS crawl_id, 'text/html' AS content_type, count(*) AS n FROM site WHERE status > 0 AND kind <> 'start'"), plain=True)
def _(spark, d):
    return S.stored(spark, d).content_types()


@query("store_batches", _ALL("SELECT CAST(1 AS BIGINT) AS crawl_id, count(*) AS pages, count(DISTINCT url) AS urls FROM site"), plain=True)
def _(spark, d):
    """Pages came in several batches, each whole, and no URL twice."""
    s = S.stored(spark, d)
    got = s.pages(1)
    if s._done().where("crawl_id = 1").count() < 3:
        raise AssertionError("pages were not stored while the crawl ran")
    return got.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


@query("store_broken", _ALL(f"{_LINKS} SELECT url, status, (SELECT count(*) FROM out WHERE to_url = site.url) AS referrers_count FROM site WHERE status >= 400 OR failed ORDER BY url LIMIT 100 OFFSET 10"), plain=True)
def _(spark, d):
    return S.stored(spark, d).broken(1, offset=10).select("url", "status", "referrers_count")


@query("store_referrers", _ALL(f"{_LINKS} SELECT to_url, from_url FROM out JOIN site s ON s.url = to_url WHERE s.status >= 400"), plain=True)
def _(spark, d):
    s = S.stored(spark, d)
    gone = [r.url for r in s.pages(1).where("status >= 400").select("url").collect()]  # each has one page that links to it
    return s.referrers(1, gone).select("to_url", "from_url")


@query("store_page_detail", _ALL(f"""{_LINKS}, chosen AS (SELECT url FROM site WHERE kind = 'page' AND status = 200 AND depth = 1)
  SELECT url, (SELECT count(*) FROM out WHERE from_url = url) AS outlinks_total, (SELECT count(*) FROM out WHERE to_url = url) AS inlinks_total,
  (SELECT string_agg(to_url, ' ' ORDER BY to_url) FROM out WHERE from_url = url) AS outlinks, (SELECT string_agg(from_url, ' ' ORDER BY from_url) FROM out WHERE to_url = url) AS inlinks FROM chosen"""), plain=True)
def _(spark, d):
    s = S.stored(spark, d)
    rows = []
    for r in s.pages(1).where(f"status = 200 AND depth = 1 AND url LIKE '{S.HOST}/p%'").select("id").collect():
        x = s.get_page(1, r.id)
        rows.append((x["page"]["url"], x["outlinks_total"], x["inlinks_total"], " ".join(sorted(o["to_url"] for o in x["outlinks"])), " ".join(sorted(i["from_url"] for i in x["inlinks"]))))
    return spark.createDataFrame(rows, "url string, outlinks_total long, inlinks_total long, outlinks string, inlinks string")


@query("store_scan", _ALL("SELECT CAST(row_number() OVER () AS BIGINT) AS n, true AS ascending FROM site"), plain=True)
def _(spark, d):
    """Every page in order of id, each held against the one before it."""
    seen = Folder(spark, "scanned").save(S.stored(spark, d).scan(1), "pages")
    before = seen.select((F.col("n") + 1).alias("n"), F.col("id").alias("last"))
    return seen.join(before, "n", "left").select("n", F.coalesce(F.col("last") < F.col("id"), F.col("n") == 1).alias("ascending"))


@query("store_migrated", "SELECT count(*) AS total, count(*) FILTER (n_nationkey % 2 = 0) AS status_2xx, CAST(0 AS BIGINT) AS via_nofollow, '' AS x_robots_tag, CAST(4 AS BIGINT) AS new_columns, CAST(1 AS BIGINT) AS counted FROM nation", plain=True)
def _(spark, d):
    """A store of an older version, without later columns and counters, brought up to date when it is opened."""
    path = Folder(spark, "old").path
    spark.sql("SELECT 1L AS id, 'https://a.test/' AS seed, 'done' AS status, '{}' AS config, current_timestamp() AS started_at, current_timestamp() AS finished_at, '' AS error").write.parquet(f"{path}/crawls/v=1")
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("long"))
    old = n.selectExpr("(1L << 40) + k + 1 AS id", "concat('https://a.test/', k) AS url", "0 AS depth", "IF(k % 2 = 0, 200, 404) AS status", "'text/html' AS content_type", "0L AS size", "0L AS duration_ms", "'' AS title", "'' AS error", "false AS noindex", "false AS nofollow", "false AS blocked")
    old.write.parquet(f"{path}/pages/crawl_id=1/version=0")
    spark.createDataFrame([(1, n.count(), 1)], "batch long, n long, crawl_id long").write.partitionBy("crawl_id").parquet(f"{path}/batches")
    s = Store(spark, path)
    added = Store.migrate(s)  # nothing is left to do
    probe = Store.__new__(Store)  # what the first opening did, seen from the files
    probe.spark, probe.path, probe._fs, probe._path = s.spark, s.path, s._fs, s._path
    new = len(set(spark.read.parquet(s.control_folder()).columns) - {"id", "seed", "status", "config", "started_at", "finished_at", "error"})
    counted = probe._counters().count()
    if added:
        raise AssertionError(f"not idempotent: {added}")
    got = s.summarize(1)
    tag = s.pages(1).agg(F.max("x_robots_tag")).first()[0]
    return spark.createDataFrame([(got["total"], got["status_2xx"], got["via_nofollow"], tag, new, counted)], "total long, status_2xx long, via_nofollow long, x_robots_tag string, new_columns long, counted long")


@query("cli_broken", _ALL(f"{_LINKS}, b AS (SELECT url, CASE WHEN status > 0 THEN CAST(status AS VARCHAR) ELSE 'ERR' END AS label, (SELECT count(*) FROM out WHERE to_url = site.url) AS n FROM site WHERE status >= 400 OR failed) SELECT label || '  ' || url || '  (' || n || ')' AS line FROM b"), plain=True)
def _(spark, d):
    from .. import cli

    out = io.StringIO()
    if cli.main(["--store", S.stored(spark, d).path, "broken", "1"], spark, out):
        raise AssertionError("the command failed")
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines() if not x.startswith(" ")], "line string")


@query("cli_pages_json", _ALL("SELECT url, title FROM site WHERE kind IN ('page', 'hidden') AND status = 200 AND depth <= 1 AND contains(lower(title), 'hidden 1')"), plain=True)
def _(spark, d):
    from .. import cli

    out = io.StringIO()
    cli.main(["--store", S.stored(spark, d).path, "pages", "1", "--status", "2xx", "-q", "HIDDEN 1", "--json"], spark, out)
    return spark.createDataFrame([(r["url"], r["title"]) for r in map(json.loads, out.getvalue().splitlines())], "url string, title string")


# the whole report of crawl 1 of the views: lists in their order, with their caps
_CP = "cp WHERE crawl_id = 1"


def _top(part: str, key: str, source: str, most: int | None, order: str) -> str:
    cut = f" QUALIFY row_number() OVER (ORDER BY {order}) <= {most}" if most else ""
    return f"SELECT '{part}' AS part, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, {key} AS key, n FROM ({source}){cut}"


_STATUS = f"SELECT CASE WHEN status > 0 THEN CAST(status AS VARCHAR) WHEN blocked THEN 'BLOQ' ELSE 'ERR' END AS key, count(*) AS n FROM {_CP} GROUP BY 1"
_TITLES = f"SELECT arg_min(clean, id) FILTER (rn = 2) AS key, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lower(clean) ORDER BY id) AS rn FROM (SELECT *, trim(regexp_replace(title, '[ \\t\\n]+', ' ', 'g')) AS clean FROM cp WHERE crawl_id = 1 AND status BETWEEN 200 AND 299 AND starts_with(content_type, 'text/html'))) GROUP BY lower(clean) HAVING count(*) > 1"
_BROKEN_N = "SELECT url AS key, (SELECT count(*) FROM cl WHERE cl.crawl_id = 1 AND cl.to_url = b.url) AS n FROM (SELECT * FROM cp WHERE crawl_id = 1 AND (status >= 400 OR status = 0 AND NOT blocked) ORDER BY url LIMIT 5000) b"
_DEPTH = f"SELECT CAST(depth AS VARCHAR) AS key, count(*) AS n FROM {_CP} GROUP BY depth"
_TYPES = f"SELECT content_type AS key, count(*) AS n FROM {_CP} AND content_type <> '' GROUP BY content_type"


@query("report_document", " UNION ALL ".join([_top("by_status", "key", _STATUS, None, "n DESC, key"), _top("duplicate_titles", "key", _TITLES, 20, "n DESC, key"), _top("top_broken", "key", _BROKEN_N, 20, "n DESC, key"), _top("by_depth", "key", _DEPTH, None, "CAST(key AS INT)"), _top("content_types", "key", _TYPES, None, "key")]))
def _(spark, d):
    from . import report

    crawl = {"id": 1, "seed": "", "status": "done", "started_at": None, "finished_at": None, "error": "", "config": "{}"}
    r = json.loads(report.to_json(report.build(crawl, pages(spark, d).where("crawl_id = 1"), links(spark, d).where("crawl_id = 1"))))
    rows = []
    for part, key, n in (("by_status", "status", "n"), ("duplicate_titles", "title", "n"), ("top_broken", "url", "referrers_count"), ("by_depth", "key", "total")):
        rows += [(part, i + 1, x[key], x[n]) for i, x in enumerate(r[part])]
    rows += [("content_types", i + 1, k, v) for i, (k, v) in enumerate(r["content_types"].items())]
    return spark.createDataFrame(rows, "part string, place int, key string, n long")


_DOT = "replace(format('{:,}', n), ',', '.')"


@query("report_markdown", f""", s AS ({_STATUS}), t AS ({_TYPES}), lines AS (
  SELECT 'Códigos' AS section, row_number() OVER (ORDER BY n DESC, key) AS place, '| ' || key || ' | ' || {_DOT} || ' |' AS line FROM s
  UNION ALL SELECT 'Tipos de contenido', row_number() OVER (ORDER BY n DESC, key), '| ' || key || ' | ' || {_DOT} || ' |' FROM t
  UNION ALL SELECT 'Cabecera', 1, 'Estado: done · Inicio: 2024-05-06 07:08:09 UTC · Fin: 2024-05-06 08:08:10 UTC · Duración: 1h0m1s'
  UNION ALL SELECT 'Cabecera', 2, 'Configuración: máx. páginas 12.345 · máx. profundidad 7 · concurrencia 0 · retardo 1.5s · subdominios: sí · robots: no')
  SELECT section, CAST(place AS INT) AS place, line FROM lines""")
def _(spark, d):
    from datetime import datetime

    from . import report

    crawl = {"id": 1, "seed": "x", "status": "done", "started_at": datetime(2024, 5, 6, 7, 8, 9), "finished_at": datetime(2024, 5, 6, 8, 8, 10), "error": "", "config": '{"max_pages":12345,"max_depth":7,"delay_ms":1500,"include_subdomains":true,"ignore_robots":true}'}
    text = report.to_markdown(report.build(crawl, pages(spark, d).where("crawl_id = 1"), links(spark, d).where("crawl_id = 1"), now=datetime(2024, 6, 1)))
    head, *sections = text.split("\n## ")
    rows = [("Cabecera", i + 1, x) for i, x in enumerate(x for x in head.split("\n") if x.startswith(("Estado", "Configuración")))]
    for s in sections:
        name, *rest = s.split("\n")
        if name in ("Códigos", "Tipos de contenido"):
            rows += [(name, i + 1, x) for i, x in enumerate([x for x in rest if x.startswith("|")][2:])]
    return spark.createDataFrame(rows, "section string, place int, line string")


@query("stream_store", "SELECT CAST(1 AS BIGINT) AS crawl_id, count(*) AS total, count(DISTINCT id) AS urls, CAST(1 AS BIGINT) AS several FROM cp")
def _(spark, d):
    """Pages that arrive as files, stored in micro-batches; what comes again is not stored again."""
    from ..streaming.ingest import stream_into

    work = Folder(spark, "stream-store")
    s = Store(spark, f"{work.path}/store")
    c = s.create_crawl("https://example.com/")
    stream_into(spark, s, c, pages(spark, d), work)
    got = s.pages(c)
    batches = s._done().count()
    return got.groupBy("crawl_id").agg(F.count("*").alias("total"), F.count_distinct("url").alias("urls")).withColumn("several", F.lit(int(batches > 1)).cast("long"))


_DEEP = "status BETWEEN 200 AND 299 AND crawl_id = 1"


@query("store_deep_page", f"SELECT url, status, title FROM cp WHERE {_DEEP} ORDER BY id LIMIT 100 OFFSET (SELECT count(*) // 2 FROM cp WHERE {_DEEP})")
def _(spark, d):
    """A page from the middle of a listing, found by the counts of batches; the same rows by its cursor."""
    from ..streaming.ingest import as_crawled

    s = Store(spark, f"{Folder(spark, 'deep').path}/store")
    c = s.create_crawl("https://example.com/")
    own = Folder(spark, "deep-pages").save(pages(spark, d).where("crawl_id = 1"), "pages")
    low, high = own.agg(F.min("id"), F.max("id")).first()
    step = (high - low) // 4 + 1
    for k in range(4):  # batches in order of id
        s.add_pages(c, as_crawled(own.where(F.col("id").between(low + k * step, low + (k + 1) * step - 1))))
    total = s.totals(c)["2xx"]
    before = s.list_pages(c, "2xx", limit=1, offset=total // 2 - 1)[0].first()
    return s.pages_after(c, "2xx", before.id, 100).select("url", "status", "title")


assert QUERIES  # registered above

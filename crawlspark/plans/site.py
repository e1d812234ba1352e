"""A site made of the driver's tables, for queries that crawl and store it, and SQL for what a crawl must find.

Pages are the customers: page k links to pages 8k + 1 to 8k + 8 that there are, so a breadth-first
crawl takes pages in order of k. Some pages redirect, fail, are barred by robots.txt or ask not
to be followed; the nations are hidden pages that only the sitemap knows.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..crawl import Crawl, Engine
from ..sources.responses import TableFetcher
from ..sources.shared import Folder
from ..store import Store, crawl_into

HOST = "https://shop.test"
START = "http://start.test/"
ROBOTS = f"""# made for tests
User-agent: otherbot
Disallow: /

User-agent: *
Disallow: /private/
Allow: /private/open
Crawl-delay: 2

Sitemap: {HOST}/sitemap.xml
"""

#: Which pages are special, as SQL over k that Spark and the oracle share.
PRIVATE, REDIRECT, GONE, BROKEN, MISSING = "k % 19 = 7", "k % 43 = 19", "k % 31 = 11", "k % 37 = 13", "k % 41 = 17"
CLOSED = "k % 29 = 9"  # meta robots nofollow
SHY = "k % 23 = 5"  # links to it are rel=nofollow
NOINDEX = "k % 7 = 3"
FANOUT = 8
_FILE_LEAST, _FILE_MOST = 2000, 100_000  # answers in a file


def path(k: str = "k") -> str:
    n = f"CAST({k} AS VARCHAR(20))"
    return f"CASE WHEN {k} = 0 THEN '/' WHEN {k} % 19 = 7 THEN concat('/private/p', {n}) ELSE concat('/p', {n}) END"


def responses(spark: SparkSession, sf_dir: str, redirects: bool = True) -> DataFrame:
    """The answers of the site, RESPONSES in part."""
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    n = nodes.count()
    nodes = nodes.repartition(max(min(-(-n // _FILE_LEAST), spark.sparkContext.defaultParallelism), -(-n // _FILE_MOST)))  # bodies are made and read by all cores
    moved = REDIRECT if redirects else "false"
    links = f"""concat_ws('', transform(filter(sequence({FANOUT} * k + 1, {FANOUT} * k + {FANOUT}), c -> c < {n}),
      c -> concat('<li><a href="', {path("c")}, '"', IF(c % 23 = 5, ' rel="NoFollow external"', ''), '>to ', c, '</a>')))"""
    body = f"""concat('<html><head><title> Page  ', k, ' </title>', IF({CLOSED}, '<meta name="Robots" content="nofollow">', ''),
      '</head><body><h1>P', k, '</h1><a href="/">home</a> <a href="mailto:x@y.test">m</a> <a href="//elsewhere.test/x">out</a><ul>', {links}, '</ul></body></html>')"""
    main = nodes.where(f"NOT ({MISSING})").selectExpr(
        f"concat('{HOST}', {path()}) AS url",
        f"CASE WHEN {moved} THEN 301 WHEN {GONE} THEN 404 WHEN {BROKEN} THEN 500 ELSE 200 END AS status",
        "'Text/HTML; charset=utf-8' AS content_type",
        f"CASE WHEN {moved} THEN concat('../moved/p', k) ELSE '' END AS location",
        f"IF({NOINDEX}, 'googlebot: none, *: noindex', '') AS x_robots_tag",
        f"CAST(CASE WHEN {moved} THEN '' ELSE {body} END AS BINARY) AS body",
        "k + 5 AS duration_ms",
    )
    target = nodes.where(moved).selectExpr(f"concat('{HOST}/moved/p', k) AS url", "200 AS status", "'text/html' AS content_type", "'' AS location", "'' AS x_robots_tag", f"CAST({body} AS BINARY) AS body", "k + 5 AS duration_ms")
    hidden = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    pages = hidden.selectExpr(f"concat('{HOST}/hidden/h', k) AS url", "200 AS status", "'text/html' AS content_type", "'' AS location", "'' AS x_robots_tag", "CAST(concat('<title>Hidden ', k, '</title>') AS BINARY) AS body", "1L AS duration_ms")
    listed = "".join(f"<url><loc> {HOST if k < 20 else 'https://elsewhere.test'}/hidden/h{k}</loc></url>" for k in range(hidden.count()))
    files = [
        (START, 302, "", HOST + "/", b""),
        ("http://start.test/robots.txt", 404, "text/plain", "", b"nothing"),
        (f"{HOST}/robots.txt", 200, "text/plain", "", ROBOTS.encode()),
        (f"{HOST}/sitemap.xml", 200, "application/xml", "", f"<sitemapindex><sitemap><loc>{HOST}/all.xml.gz</loc></sitemap><sitemap><loc>{HOST}/none.xml</loc></sitemap></sitemapindex>".encode()),
        (f"{HOST}/all.xml.gz", 200, "application/gzip", "", gzip.compress(f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{listed}<url><loc></loc></url></urlset>'.encode(), mtime=0)),
    ]
    extra = spark.createDataFrame(files, "url string, status int, content_type string, location string, body binary").selectExpr("url", "status", "content_type", "location", "'' AS x_robots_tag", "body", "0L AS duration_ms")
    all_rows = main.unionByName(target).unionByName(pages).unionByName(extra)
    return all_rows.withColumn("size", F.octet_length("body").cast("long"))


def _saved(work: Folder, answers: DataFrame) -> DataFrame:
    """answers as a written table whose files tell by a filter whether they may have a url."""
    return work.save(answers, "responses", **{"parquet.bloom.filter.enabled#url": "true"})


def crawl(spark: SparkSession, sf_dir: str, seed: str = START, redirects: bool = True, **settings) -> Crawl:
    settings = {"max_pages": 10_000_000, "delay_ms": 0} | settings
    answers = _saved(Folder(spark, "site"), responses(spark, sf_dir, redirects))
    return Engine(spark, Config(seed=seed, **settings), TableFetcher(answers)).run()


_stores: dict[tuple[str, str], Store] = {}


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The site crawled into a store (crawl 1, nofollow links followed); once a session, as the queries over the store share it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        work = Folder(spark, "site-store")
        answers = _saved(work, responses(spark, sf_dir))
        store = Store(spark, f"{work.path}/store")
        crawl_into(store, Config(seed=START, max_pages=10_000_000, delay_ms=0, follow_nofollow=True), TableFetcher(answers))
        _stores[key] = store
    return _stores[key]


def oracle(sql: str, follow: bool = False, depth: int = 10, redirects: bool = True) -> str:
    """SQL over site (kind, k, url, depth, status, blocked, via_nofollow, noindex, title, failed): what a crawl from START finds.

    reach has the pages k that are queued, found the rows of site by kind: start, page, moved, hidden.
    """
    moved = REDIRECT if redirects else "false"
    shy = "(n.k % 23 = 5 OR r.k % 29 = 9)"
    return f"""WITH RECURSIVE node AS (SELECT c_custkey AS k FROM customer),
  reach(k, depth, via, parent) AS (
    SELECT CAST(0 AS BIGINT), 0, false, CAST(NULL AS BIGINT)
    UNION ALL
    SELECT n.k, r.depth + 1, {shy}, r.k FROM reach r JOIN node n ON n.k > 0 AND (n.k - 1) // {FANOUT} = r.k
    WHERE r.depth < {depth} AND NOT (r.{PRIVATE}) AND NOT (r.{MISSING}) {"" if follow else f"AND NOT {shy}"}),
  site AS (
    SELECT 'start' AS kind, CAST(-1 AS BIGINT) AS k, '{START}' AS url, 0 AS depth, 302 AS status, false AS blocked, false AS via_nofollow, false AS noindex, '' AS title, false AS failed
    UNION ALL
    SELECT 'page', k, concat('{HOST}', {path()}), depth,
      CASE WHEN {PRIVATE} OR {MISSING} THEN 0 WHEN {moved} THEN 301 WHEN {GONE} THEN 404 WHEN {BROKEN} THEN 500 ELSE 200 END,
      {PRIVATE}, via AND NOT ({PRIVATE}), {NOINDEX} AND NOT ({PRIVATE}) AND NOT ({MISSING}),
      CASE WHEN {PRIVATE} OR {MISSING} OR {moved} THEN '' ELSE 'Page ' || k END, {MISSING} AND NOT ({PRIVATE})
    FROM reach
    UNION ALL
    SELECT 'moved', k, concat('{HOST}/moved/p', CAST(k AS VARCHAR(20))), depth, 200, false, false, false, 'Page ' || k, false
    FROM reach WHERE {moved} AND NOT ({PRIVATE}) AND NOT ({MISSING})
    UNION ALL
    SELECT 'hidden', n_nationkey, '{HOST}/hidden/h' || n_nationkey, 1, 200, false, false, false, 'Hidden ' || n_nationkey, false
    FROM nation WHERE n_nationkey < 20)
  {sql}"""

"""Crawl-shaped views of the driver's tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAGES_SQL = """
SELECT id, crawl_id, url, depth, status, content_type, size, duration_ms, title, meta_robots, noindex, nofollow, via_nofollow, blocked,
  CASE WHEN status <> 301 THEN ''
    WHEN id % 10 = 0 THEN concat(url, '/')
    WHEN id % 10 = 1 THEN substring(url, 1, length(url) - 1)
    WHEN id % 10 = 2 THEN replace(url, 'http://', 'https://')
    WHEN id % 10 = 3 THEN concat('https://example.com', upper(substring(url, 20)))
    WHEN id % 10 = 4 THEN replace(url, '?utm=1', '')
    WHEN id % 10 = 5 THEN replace(url, '/s', '/t')
    WHEN id % 10 = 6 THEN concat('https://example.com/en', substring(url, 20))
    WHEN id % 10 = 7 THEN 'https://other.example.org/'
    WHEN id % 10 = 8 THEN 'https://example.com/nuevo/sitio/x/y'
    ELSE '' END AS redirect_to,
  CASE WHEN status <> 0 OR blocked THEN ''
    WHEN id % 7 = 0 THEN concat('Get "', url, '": context deadline exceeded')
    WHEN id % 7 = 1 THEN 'dial tcp: connect: connection refused'
    WHEN id % 7 = 2 THEN 'x509: certificate signed by unknown authority'
    WHEN id % 7 = 3 THEN 'unexpected EOF'
    WHEN id % 7 = 4 THEN 'lookup x: no such host'
    WHEN id % 7 = 5 THEN 'body truncated'
    ELSE concat('Get "', url, '": odd failure') END AS error
FROM (SELECT event_id AS id, user_id % 4 + 1 AS crawl_id,
  concat(CASE WHEN event_id % 10 = 2 THEN 'http' ELSE 'https' END, '://example.com/',
    CASE event_id % 4 WHEN 0 THEN 'en/' WHEN 1 THEN 'es/' WHEN 2 THEN 'FR/' ELSE '' END,
    's', CAST(event_id % 60 AS VARCHAR(20)), '/p', CAST(event_id AS VARCHAR(20)),
    CASE event_id % 10 WHEN 1 THEN '/' WHEN 4 THEN '?utm=1' ELSE '' END) AS url,
  CAST(event_id % 6 AS INT) AS depth,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 500 ELSE 0 END AS status,
  CASE event_type WHEN 'view' THEN 'text/html' WHEN 'signup' THEN 'text/html' WHEN 'purchase' THEN 'application/json' ELSE '' END AS content_type,
  CAST(floor(value * 100) AS BIGINT) AS size, CAST(floor(value) AS BIGINT) AS duration_ms,
  concat('  Title ', CAST(event_id % 500 AS VARCHAR(20)), '   Page ') AS title,
  CASE WHEN event_id % 7 = 0 THEN 'noindex' ELSE '' END AS meta_robots,
  event_id % 7 = 0 AS noindex, event_id % 11 = 0 AS nofollow, event_id % 13 = 0 AS via_nofollow,
  event_type = 'error' AND event_id % 5 = 0 AS blocked
FROM {events}) e
"""

LINKS_SQL = """
SELECT ((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey AS id,
  f.crawl_id, f.id AS from_page_id, t.url AS to_url, concat('link ', CAST(l.l_suppkey AS VARCHAR(20))) AS text,
  l.l_linenumber % 3 = 0 AS nofollow, t.crawl_id = f.crawl_id AS in_scope
FROM {lineitem} l JOIN {pages} f ON f.id = l.l_orderkey JOIN {pages} t ON t.id = l.l_partkey
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINKS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), pages=pages(spark, sf_dir))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def oracle(sql: str) -> str:
    """SQL over cp and cl for an engine that has the driver's tables as views."""
    ctes = [f"cp AS ({PAGES_SQL.format(events='events')})"]
    if re.search(r"\bcl\b", sql):
        ctes.append(f"cl AS ({LINKS_SQL.format(lineitem='lineitem', pages='cp')})")
    recursive = sql.startswith("RECURSIVE ")
    sql = sql.removeprefix("RECURSIVE ")
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)}" + (sql if sql.startswith(",") else f" {sql}")

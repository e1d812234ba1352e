"""html_title_h1 against its SQL where pages hold more character references than &amp;."""

import duckdb

from crawlspark.functions.html import parse_html
from crawlspark.plans.catalogue import ORACLE_SQL, QUERIES

TEXTS = ["a &amp; b", "cut &amp", "say &quot;x&quot;", "&amp;quot; &lt;b&gt;", "&#65; &notin; &", "plain", "&amp;amp; &AMP; x&nbsp"]


def test_title_and_h1_are_those_of_the_sql(spark, tmp_path):
    rows = [(i, f"https://a.test/{i}", f"<!DOCTYPE html><title> {t}\n</title><body><h1>{t}</h1>") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["html_title_h1"]).fetchall())
    assert sorted(map(tuple, QUERIES["html_title_h1"](spark, str(tmp_path)).collect())) == want


def test_the_parser_resolves_all_references():
    got = parse_html("<title>say &quot;x&quot; &amp</title>", "https://a.test/", "a.test", False)
    assert got["title"] == 'say "x" &'

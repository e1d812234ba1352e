import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_stands_without_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'broken_links' in q and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


def test_names():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and [r.url for r in rows] == sorted(r.url for r in rows)
    assert all(r.referrers_count >= 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["summary", "report_by_section", "report_redirects", "referrers_top3", "recompute_via_nofollow", "robots_allowed", "crawl_bfs", "stream_counters", "broken_with_referrers", "crawl_site_budget", "store_pages", "store_links", "store_summary", "store_broken", "store_migrated", "report_document", "html_links", "html_tree", "labels", "crawl_bfs_whole"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    got = e.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in ("events", "lineitem", "pages", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))

"""Pages of listings deep down, cursors and lookups: the same rows as a sort of all, from a bounded part of the files."""

import pytest
from pyspark.sql import functions as F

from crawlspark import store as store_module
from crawlspark.operators import pages as P
from crawlspark.store import Store
from tests.test_store_and_crawl import batch, link


@pytest.fixture(scope="module")
def st(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('deep')}/s")
    c = s.create_crawl("https://s.test/")
    for k in range(6):
        s.add_pages(c, batch(spark, *({"url": f"u{k}-{i}", "status": [200, 404, 301, 200, 0][(i + k) % 5], "error": "x" if (i + k) % 5 == 4 else "", "via_nofollow": k == 2, "links": [link(f"u{(k + 1) % 6}-{i}")]} for i in range(40))))
    return s


def scanned(df) -> int:
    """Rows that the scans of a plan have given out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.children().isEmpty():
            if p.getClass().getSimpleName() == "FileSourceScanExec" and "title" in p.schema().fieldNames():
                leaves += p.metrics().apply("numOutputRows").value()
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return leaves


@pytest.mark.parametrize("status", ["", "2xx", "4xx", "error", "via_nofollow", "blocked"])
def test_same_rows_as_a_sort(st, status):
    p = st.pages(1)
    want = [r.id for r in P.matching(p, 1, status).orderBy("id").collect()]
    for offset, limit in ((0, 7), (39, 3), (len(want) - 5, 10), (len(want) // 2, 60), (len(want), 5), (10_000, 5)):
        rows, total = st.list_pages(1, status, limit=limit, offset=offset)
        offset = max(0, offset)
        assert [r.id for r in rows.collect()] == want[offset : offset + limit] and total == len(want)
    assert [r.id for r in st.all_pages(1, status, 23)] == want


def test_a_deep_page_reads_its_batch(st):
    rows, _ = st.list_pages(1, limit=5, offset=201)
    assert scanned(rows) <= 40
    assert scanned(st.pages_after(1, "", st.pages(1).agg(F.max("id")).first()[0] - 3, 10)) <= 40
    assert scanned(P.list_pages(st.pages(1), 1, limit=5, offset=201)) == 240


def test_large_batches_are_not_sorted(st, monkeypatch):
    want = [r.id for r in st.pages(1).orderBy("id").collect()]
    monkeypatch.setattr(store_module, "_SORTED", 10)
    for offset in (11, 79, 100, 239):
        assert [r.id for r in st.list_pages(1, limit=4, offset=offset)[0].collect()] == want[offset : offset + 4]


def test_lookups_open_what_may_hold_the_value(st):
    assert scanned(P.find_page(st.pages(1), 1, url="u3-7")) <= 40
    assert scanned(P.find_page(st.pages(1), 1, url="nowhere")) == 0
    assert scanned(P.find_page(st.pages(1), 1, id=st.find_page(1, "u3-7")["id"])) <= 40
    d = st.get_page(1, st.find_page(1, "u3-7")["id"])
    assert [x["to_url"] for x in d["outlinks"]] == ["u4-7"] and [x["from_url"] for x in d["inlinks"]] == ["u2-7"]


def test_after_compaction(st):
    want = [r.id for r in st.pages(1).orderBy("id").collect()]
    st.compact(1)
    assert [r.id for r in st.list_pages(1, limit=30, offset=110)[0].collect()] == want[110:140]
    assert st.find_page(1, "u5-39")["id"] == want[-1]

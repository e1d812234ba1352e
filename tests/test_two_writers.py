"""Several processes change one store: each has a Store of its own over the same folder."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from crawlspark import store as S
from crawlspark.sources.exclusive import Exclusive
from crawlspark.store import Conflict, NotFound, Store

from tests.test_store_and_crawl import SITE, batch, link


def together(*calls):
    """Run calls at the same time; their results, or what they raised."""
    out = [None] * len(calls)
    ready = threading.Barrier(len(calls))

    def run(i, f):
        ready.wait()
        try:
            out[i] = f()
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


@pytest.mark.parametrize("local", [True, False])
def test_numbers_have_one_taker(spark, tmp_path, local):
    takers = [Exclusive(spark, f"file://{tmp_path}/n") for _ in range(4)]
    for t in takers:
        t._local = local
    assert takers[0].take(1, "first") and not takers[1].take(1, "second") and takers[2].text(1) == "first"
    if local:  # renames of a local folder do not hold off each other
        got = together(*(lambda t=t: [t.next(1) for _ in range(5)] for t in takers))
        assert sorted(sum(got, [])) == list(range(2, 22))
    else:
        assert [t.next(1) for t in takers] == [2, 3, 4, 5]
    left = max(takers[0].taken())
    takers[0].forget(left, 3600)
    assert len(takers[1].taken()) == left
    takers[0].forget(left, -1)
    assert list(takers[1].taken()) == [left]


def test_no_change_is_lost(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    ids = together(lambda: a.create_crawl(SITE), lambda: b.create_crawl(SITE), lambda: a.create_crawl(SITE), lambda: b.create_crawl(SITE))
    assert sorted(ids) == [1, 2, 3, 4] and a.crawls().count() == 4
    together(lambda: a.set_robots(1, "x"), lambda: b.set_robots(2, "y"), lambda: b.delete_crawl(4))
    assert {r.id: r.robots_txt for r in b.crawls().collect()} == {1: "x", 2: "y", 3: ""}
    together(lambda: a.finish_crawl(3, "done"), lambda: b.finish_crawl(3, "cancelled"))
    first = a.get_crawl(3)
    b.finish_crawl(3, "failed", "late")
    assert first["status"] in ("done", "cancelled") and b.get_crawl(3) == first
    for call in (lambda: a.set_robots(9, ""), lambda: a.delete_crawl(9), lambda: a.finish_crawl(9, "done")):
        with pytest.raises(NotFound):
            call()


def test_batches_have_numbers_of_their_own(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    c, d = a.create_crawl(SITE), b.create_crawl(SITE)
    got = together(*(lambda s=s, c=c, i=i: s.add_pages(c, batch(spark, {"url": f"u{i}", "links": [link("x")]})) for i, (s, c) in enumerate([(a, c), (b, d)])))
    assert got == [1, 1]
    numbers = [r[0] for r in a.pages().select(F.shiftright("id", S._SHIFT)).collect()]
    assert len(set(numbers)) == 2 and (a.links(c).count(), a.links(d).count()) == (1, 1)


def test_a_replaced_version_is_a_conflict(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    c = a.create_crawl(SITE)
    a.add_pages(c, batch(spark, {"url": "u1"}, {"url": "u2"}))
    was = b.get_crawl(c)
    before = b.pages(c)
    a.compact(c)
    with pytest.raises(Conflict):
        b._switch(c, was, {"pages": (before.limit(1), S.PAGES)})
    assert a.pages(c).count() == 2 and b.get_crawl(c)["pages_version"] == a.get_crawl(c)["pages_version"]
    b.compact(c)
    assert b.pages(c).count() == 2


def test_a_reader_keeps_its_table(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    c = st.create_crawl(SITE)
    planned = st.crawls()
    for i in range(4):
        st.set_robots(c, str(i))
    assert planned.first().robots_txt == ""


def test_old_tables_go(spark, tmp_path, monkeypatch):
    st = Store(spark, f"file://{tmp_path}/s")
    c = st.create_crawl(SITE)
    for i in range(3):
        st.set_robots(c, str(i))
    assert len(list((tmp_path / "s" / "crawls").iterdir())) == 4
    monkeypatch.setattr(S, "_KEPT", 0)
    time.sleep(0.1)
    st.set_robots(c, "last")
    assert len(st._control.taken()) < 4 and st.get_crawl(c)["robots_txt"] == "last"

"""Runs of URL hashes: lookups against a set, levels, what is read, and two writers."""

import random

import pytest
from pyspark.sql import functions as F

from crawlspark.crawl import nth
from crawlspark.sources.shared import Folder
from crawlspark.sources.url_runs import Conflict, UrlRuns, hashes


def keys(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string").select("url", *hashes(F.col("url")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_new_and_levels(spark):
    runs, have, r = UrlRuns(spark, f"{Folder(spark, 'runs').path}/u", fan=3), set(), random.Random(1)
    for k in range(7):
        some = {f"https://s.test/{r.randint(0, 400)}" for _ in range(90)}
        with runs.settings():
            absent = runs.absent(keys(spark, some).dropDuplicates(["h1", "h2"]))
            assert {x.url for x in absent.collect()} == some - have
        new = keys(spark, some - have)
        assert runs.any_of(keys(spark, some), len(some)) == [] if not have & some else runs.any_of(keys(spark, some), len(some))
        runs.add(new.repartition(runs.buckets, "h1", "h2"))
        have |= some
        assert len(runs.runs) <= 2 + 2
    assert sorted(x["level"] for x in runs.runs) == [0, 1, 1]
    again = UrlRuns(spark, runs.path)
    assert again.runs == runs.runs and again.buckets == runs.buckets
    total = sum(spark.read.parquet(f"{runs.path}/{x['name']}").count() for x in runs.runs)
    assert total == len(have)
    assert len([x for x in runs._fs.listStatus(runs._Path(runs.path)) if x.getPath().getName().startswith("run-")]) == 3
    runs.close()
    again.close()


def test_runs_are_not_shuffled(spark):
    runs = UrlRuns(spark, f"{Folder(spark, 'runs').path}/u")
    for part in (range(500), range(500, 900)):
        runs.add(keys(spark, map(str, part)).repartition(runs.buckets, "h1", "h2"))
    with runs.settings():
        found = keys(spark, map(str, range(800, 1000))).groupBy("h1", "h2").agg(F.min("url").alias("url"))
        fresh = runs.absent(found)
        assert plan(fresh).split("Initial Plan")[0].count("Exchange hash") == 1  # the finds
        assert sorted(int(x.url) for x in fresh.collect()) == list(range(900, 1000))
    runs.close()


def test_few_keys_open_only_what_may_hold_them(spark):
    runs = UrlRuns(spark, f"{Folder(spark, 'runs').path}/u", buckets=1)
    runs.add(keys(spark, map(str, range(20_000))).repartition(1, "h1", "h2"))
    one = keys(spark, ["77"]).first()

    def read(first):
        with runs.settings(few=True):
            df = runs.lookup(runs.runs[0], first)
            rows = df.collect()
        scan = [m for m in str(df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()).split()]
        return rows, int(scan[0])

    rows, n = read([one.h1])
    assert [(r.h1, r.h2) for r in rows] == [(one.h1, one.h2)] and n <= 20_000
    assert read([one.h1 + 1, one.h1 - 1]) == ([], 0)  # the Bloom filter has neither
    assert runs.any_of(keys(spark, ["77"]), 1) == [runs.runs[0]["name"]] and runs.any_of(keys(spark, ["x77"]), 1) == []
    runs.close()


def test_two_writers_cannot_both_win(spark):
    path = f"{Folder(spark, 'runs').path}/u"
    a, b = UrlRuns(spark, path), UrlRuns(spark, path)
    a.add(keys(spark, ["1"]).repartition(a.buckets, "h1", "h2"))
    with pytest.raises(Conflict):
        b.add(keys(spark, ["1"]).repartition(b.buckets, "h1", "h2"))
    assert UrlRuns(spark, path).runs == a.runs
    a.close()
    b.close()


def test_the_nth_item_without_a_sort(spark):
    r = random.Random(2)
    have = sorted({(p << 33) + r.randrange(50_000) for p in (0, 2, 9) for _ in range(300)})
    df = spark.createDataFrame([(x,) for x in have], "seq long").repartition(3)
    for n in (1, 2, 299, 301, len(have)):
        assert nth(df, n) == have[n - 1]


def test_store_knows_what_is_new_without_the_crawl(spark, tmp_path):
    from crawlspark.store import Store
    from tests.test_store_and_crawl import batch

    st = Store(spark, f"file://{tmp_path}/s")
    c = st.create_crawl("https://s.test/")
    for k in range(5):
        st.add_pages(c, batch(spark, *({"url": f"u{k}-{i}", "status": [200, 404, 302][i % 3], "via_nofollow": i == 1} for i in range(6))))
    read = []
    st.pages = (lambda real: lambda *a: read.append(1) or real(*a))(st.pages)
    st.add_pages(c, batch(spark, {"url": "new", "blocked": True}))
    assert read == []  # no page of the crawl is read
    with pytest.raises(ValueError):
        st.add_pages(c, batch(spark, {"url": "u3-2"}, {"url": "more"}))
    assert read == [1]
    totals = st.totals(c)
    assert totals == {"": 31, "2xx": 10, "3xx": 10, "4xx": 10, "5xx": 0, "error": 0, "blocked": 1, "via_nofollow": 5, "broken": 10}
    for f in ("", "2xx", "3xx", "4xx", "5xx", "error", "blocked", "via_nofollow"):
        rows, total = st.list_pages(c, f, limit=100)
        assert rows.count() == total == totals[f]
    ids = [r.id for r in st.pages(c).orderBy("id").collect()]
    assert len(set(ids)) == 31
    # a batch that broke after its run was written, and one whose run is missing
    st._urls(c)[0].add(spark.createDataFrame([("lost",)], "url string").select(*hashes(F.col("url"))).repartition(4, "h1", "h2"), [99], set())
    again = Store(spark, st.path)
    st._fs.delete(st._path(f"{st.path}/urls/crawl_id={c}/manifest"), True)
    assert again.add_pages(c, batch(spark, {"url": "lost"})) == 1
    with pytest.raises(ValueError):
        again.add_pages(c, batch(spark, {"url": "u0-0"}))
    with pytest.raises(ValueError):
        again.add_pages(c, batch(spark, {"url": "lost"}))


def test_links_are_numbered_in_the_order_of_pages(spark, tmp_path):
    from crawlspark.store import Store
    from tests.test_store_and_crawl import batch, link

    st = Store(spark, f"file://{tmp_path}/s")
    c = st.create_crawl("https://s.test/")
    st.add_pages(c, batch(spark, *({"url": f"u{i}", "links": [link(f"t{i}-{j}") for j in range(i % 4)]} for i in range(30))))
    got = [r.to_url for r in st.links(c).orderBy("id").collect()]
    assert got == [f"t{i}-{j}" for i in range(30) for j in range(i % 4)]
    assert st.links(c).select("id").distinct().count() == len(got)

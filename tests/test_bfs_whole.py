"""The crawl queries to the default depth against a breadth-first search in Python."""

import os
from collections import defaultdict

import pytest

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("follow", [False, True])
def test_whole_crawl(spark, follow):
    import __spark_entry__ as e
    from crawlspark.config import Config
    from crawlspark.plans.views import links, pages

    page = {r.id: r for r in pages(spark, DATA).select("id", "url", "nofollow").collect()}
    edges, starts = defaultdict(set), set()
    for x in links(spark, DATA).where("in_scope").select("from_page_id", "to_url", "nofollow").collect():
        if follow or not x.nofollow and not page[x.from_page_id].nofollow:
            edges[page[x.from_page_id].url].add(x.to_url)
            starts.add(x.from_page_id)
    wave = [page[i].url for i in sorted(starts)[:20]]
    seen = dict.fromkeys(wave, 0)
    for depth in range(1, Config().max_depth + 1):
        wave = {y for x in wave for y in edges[x]} - set(seen)
        seen |= dict.fromkeys(wave, depth)
    print(len(seen), sum(d <= 4 for d in seen.values()), max(seen.values()))
    assert max(seen.values()) > 4  # what a depth of 4 drops
    got = e.queries()["crawl_bfs_whole" + "_follow_nofollow" * follow](spark, DATA).collect()
    assert len(got) == len(seen) and {r.url: r.depth for r in got} == seen

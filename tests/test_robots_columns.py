"""robots.txt as columns against the parser of one file."""

import random

from pyspark.sql import functions as F

from crawlspark.functions import robots as B


def test_columns_agree_with_the_parser(spark):
    r = random.Random(6)
    lines = ["User-agent: *", "User-agent: CrawlSpark", "user-agent: other", "USER-AGENT : a-crawlspark-b # c", "Disallow: /a", "Allow: /a/b", "Disallow: /*.pdf$", "Disallow:", "Allow: /x(1", "Crawl-delay: 2", "Crawl-delay: -1", "crawl-delay: nonsense", "Sitemap: s", "nonsense", "Disallow: /é$", "# x", "", "Allow: *", "Disallow: /a\\d"]
    ends = ["\n", "\r\n", "\r", "\x0b"]
    bodies = ["".join(r.choice(lines) + r.choice(ends) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["", None]
    paths = ["/", "/a", "/a/b", "/a/b.pdf", "/x(1", "/é", "/éa", "/a\\d", "/a5"]
    files = spark.createDataFrame([(f"h{i}", b) for i, b in enumerate(bodies)], "host string, body string")
    urls = spark.createDataFrame([(f"h{i}", p) for i in range(len(bodies) + 1) for p in paths], "host string, path string")
    got = {(x.host, x.path): (x.allowed, x.delay) for x in B.allowed_by_host(urls, files, "crawlspark").collect()}
    for i, body in enumerate([*bodies, ""]):
        one = B.parse_robots(body or "")
        for p in paths:
            assert got[f"h{i}", p] == (one.allowed("crawlspark", p), one.crawl_delay("crawlspark")), (body, p)
    plan = B.allowed_by_host(urls, files, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert B.token_rules(files.where("host = 'h400'"), "body", "").select(F.size("rules")).first()[0] == 0

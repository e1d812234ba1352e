"""Single answers are asked of the files of a table, and the site's answers are dealt over all cores."""

import random

from pyspark.sql import functions as F

from crawlspark.config import Config
from crawlspark.crawl import Engine
from crawlspark.functions import normalize as N
from crawlspark.functions.html_tree import parse
from crawlspark.plans import site as S
from crawlspark.sources.responses import TableFetcher


def test_one_answer_is_looked_up_by_a_pushed_filter(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('https://a.test/', id) AS url", "200 AS status", "'text/html' AS content_type", "CAST(concat('<title>', id, '</title>') AS BINARY) AS body")
    rows.write.option("parquet.bloom.filter.enabled#url", "true").parquet(str(tmp_path / "answers"))
    asked = []

    class Recorded(TableFetcher):
        def fetch_one(self, url):
            asked.append(super().fetch_one(url))
            return asked[-1]

    fetcher = Recorded(spark.read.parquet(str(tmp_path / "answers")))
    engine = Engine(spark, Config(seed="https://a.test/"), fetcher)
    for url in ("https://a.test/7", "https://a.test/none"):
        want = fetcher.fetch(spark.createDataFrame([(url,)], "url string")).first().asDict()
        assert engine._one(url) == want and want["url"] == url
        assert f"EqualTo(url,{url})" in asked[-1]._jdf.queryExecution().executedPlan().toString()
    assert len(asked) == 2


def test_answers_of_one_file_are_made_by_all_cores(spark, tmp_path):
    spark.range(9000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25).selectExpr("id AS n_nationkey").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    answers = S.responses(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    pages = answers.where(f"url LIKE '{S.HOST}/p%'")
    assert pages.select("task").distinct().count() >= spark.sparkContext.defaultParallelism


def test_paths_and_tags_read_fast_are_read_alike():
    r = random.Random(3)

    def slow(path):  # RFC 3986, 5.2.4
        out, parts = [], path.split("/")[1:]
        for k, p in enumerate(parts):
            if p == "..":
                del out[-1:]
            elif p != ".":
                out.append(p)
                continue
            if k == len(parts) - 1:
                out.append("")
        return "/" + "/".join(out)

    for _ in range(3000):
        path = "/" + "".join(r.choice(["a", ".", "..", "/", "/", ".b", "c.d"]) for _ in range(r.randrange(7)))
        assert N.without_dots(path) == slow(path)
    for url in ("/a\x1f", "/a\x00b", "\x7f", "/a\tb"):
        assert N.try_normalize(url.join("xx"), "https://a.test/") is None
    bare = ["<p>", "<a >", "<a/>", "</a>", "</p >", "<i>", "</i/>", "<b", "x"]
    for _ in range(300):
        text = "".join(r.choice(bare) for _ in range(8))
        assert [(n.tag, n.attrs) if not isinstance(n, str) else n for n in parse(text).walk()] == [(n.tag, n.attrs) if not isinstance(n, str) else n for n in parse(text.replace(">", " >").replace("/ >", "/>")).walk()]

"""A wave of small pages is parsed by many tasks, and numbering by place gives the places."""

from pyspark.sql import functions as F

from crawlspark.config import Config
from crawlspark.crawl import Engine
from crawlspark.sources.responses import TableFetcher
from crawlspark.sources.shared import Folder


def test_a_wave_is_parsed_by_all_cores(spark):
    n = 2000
    answers = spark.range(n).selectExpr("concat('https://a.test/', id) AS url", "200 AS status", "'text/html' AS content_type", "CAST(concat('<title>', id, '</title>') AS BINARY) AS body")
    wave = spark.range(n + 1).selectExpr("id AS seq", "concat('https://a.test/', id) AS url", "1 AS depth")
    got = Engine(spark, Config(seed="https://a.test/"), TableFetcher(answers))._parsed(wave, "a.test", n + 1)
    rows = got.withColumn("task", F.spark_partition_id()).select("seq", "title", "error", "task").collect()
    assert len({r.task for r in rows}) >= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.seq, r.title) for r in rows) == [(i, str(i)) for i in range(n)] + [(n, "")]
    assert [r.seq for r in rows if r.error] == [n]


def test_numbers_and_sums_before(spark):
    rows = spark.range(500).selectExpr("pmod(id * 7919, 500) AS k", "id AS at")
    got = Folder(spark, "numbered").numbered(rows, "rows", "k", weight=F.col("k") % 4).select("k", "n", "before").orderBy("n").collect()
    assert [(r.k, r.n) for r in got] == [(k, k + 1) for k in range(500)]
    assert [r.before for r in got] == [sum(j % 4 for j in range(k)) for k in range(500)]

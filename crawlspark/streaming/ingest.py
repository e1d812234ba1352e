"""Micro-batch ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import counters
from ..schema import CRAWLED
from ..sources.shared import Folder


def ingest(source: DataFrame, write_batch, checkpoint: str, interval: str | None = "1 second"):
    """Start a stream that gives each micro-batch to write_batch(batch, batch_id); with no interval, all that is there and stop."""
    writer = source.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: Keeps the state of streams on the executors' disks.
_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def running_counters(source: DataFrame, path: str, interval: str | None = "1 second"):
    """Start a stream that keeps the counters of every crawl as state and writes those that a micro-batch changes.

    The state is a row a crawl; sums and the largest depth go on from the checkpoint when the stream is started
    again. A micro-batch that is repeated after a failure writes its rows anew.
    """
    spark = source.sparkSession
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        totals = source.groupBy("crawl_id").agg(*counters())
        write = lambda rows, batch_id: rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}")
        writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters that a stream has last written for every crawl."""
    rows = spark.read.parquet(f"{path}/totals")
    names = [c for c in rows.columns if c not in ("crawl_id", "batch")]
    return rows.groupBy("crawl_id").agg(F.max_by(F.struct(*names), F.col("batch").cast("long")).alias("x")).select("crawl_id", "x.*")


def streamed_counters(spark: SparkSession, pages: DataFrame, files: int = 4) -> DataFrame:
    """Counters by crawl of pages that arrive as files, the later half of them after the stream has stopped and been started again."""
    work = Folder(spark, "stream")
    halves = pages.withColumn("_half", F.pmod(F.xxhash64("id"), F.lit(2)))
    for half in (0, 1):
        halves.where(F.col("_half") == half).drop("_half").repartition(max(1, files // 2)).write.mode("append").parquet(f"{work.path}/in")
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{work.path}/in")
        running_counters(stream, work.path, None).awaitTermination()
    return read_counters(spark, work.path)


def store_stream(store, crawl_id: int, source: DataFrame, checkpoint: str, interval: str | None = "1 second"):
    """Start a stream that stores each micro-batch of crawled pages (schema CRAWLED) as a batch of a crawl.

    A micro-batch that is repeated after a failure finds its URLs stored and adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = store.unseen(crawl_id, batch)
        if not new.isEmpty():
            store.add_pages(crawl_id, new, saved=True, new=True)

    return ingest(source, write, checkpoint, interval)


def as_crawled(pages: DataFrame) -> DataFrame:
    """Pages of a view as crawled pages (schema CRAWLED) without links, in order of id."""
    absent = {"string": "''", "boolean": "false", "int": "0", "bigint": "0L", "timestamp": "current_timestamp()"}
    have = set(pages.columns)
    blank = [("id" if f.name == "seq" else f.name if f.name in have else absent.get(f.dataType.simpleString(), "array()")) for f in CRAWLED.fields]
    return pages.selectExpr(*(f"CAST({x} AS {f.dataType.simpleString()}) AS {f.name}" for x, f in zip(blank, CRAWLED.fields)))


def stream_into(spark: SparkSession, store, crawl_id: int, pages: DataFrame, work: Folder, files: int = 3) -> None:
    """Store pages that arrive as files, a file a micro-batch, the first of them twice."""
    rows = as_crawled(pages)
    rows.repartition(files).write.parquet(f"{work.path}/in")
    rows.where("seq % 10 = 0").coalesce(1).write.mode("append").parquet(f"{work.path}/in")
    stream = spark.readStream.schema(CRAWLED).option("maxFilesPerTrigger", 1).parquet(f"{work.path}/in")
    store_stream(store, crawl_id, stream, f"{work.path}/checkpoint", None).awaitTermination()

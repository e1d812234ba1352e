"""A folder for intermediate tables that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own temporary folder only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="crawlspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


class Folder:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df, with options of the writer, and return it as read back."""
        at = f"{self.path}/{name}"
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def numbered(self, df: DataFrame, name: str, *order: str, weight=None) -> DataFrame:
        """df with n = 1, 2, ... in an order, counted in parallel: ranks within range partitions plus the counts before them.

        weight: a column of whole numbers; `before` is then their sum over all rows before.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        weight = F.lit(0) if weight is None else weight
        # a row's place in its sorted partition is the low 33 bits of its id there, the partition the bits above
        placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        cut = self.save(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)).withColumn("_w", weight.cast("long")), name)
        above = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
        sums = cut.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.sum("_w").alias("_sum"))
        bases = sums.select("_p", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"), F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_wbase"))
        both = cut.join(F.broadcast(bases), F.col("_part") == F.col("_p")).withColumn("n", F.col("_base") + F.col("_at") + 1)
        # rows are dealt anew only for who reads `before`
        own = F.coalesce(F.sum("_w").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return both.withColumn("before", F.col("_wbase") + own).drop("_part", "_at", "_w", "_p", "_base", "_wbase")

"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) of every node of edges (a, b); the root is the least node of the component.

    Counts of changed rows are all that reaches the driver. Rounds are about the
    logarithm of the longest path.
    """
    e = work.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    before, number = None, 0
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, number = state, number + 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(work.save(least, f"{name}-{number}-l"), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.save(large, f"{name}-{number}-large")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))  # a > b in every row now
        joined = large.join(work.save(least, f"{name}-{number}-s"), F.col("a") == F.col("u"))
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = work.save(small, f"{name}-{number}")
        work.drop(f"{name}-{number - 1}", f"{name}-{number}-l", f"{name}-{number}-large", f"{name}-{number}-s")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

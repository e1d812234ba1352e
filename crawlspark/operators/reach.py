"""Reachability by links: rounds of joins with what was not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Folder


def first_starts(pages: DataFrame, links: DataFrame, n: int, follow_nofollow: bool = False) -> list[int]:
    """The n least ids of pages with an in-scope link that may be followed."""
    on = links.where("in_scope")
    if not follow_nofollow:
        on = on.where(~F.col("nofollow")).join(pages.where(~F.col("nofollow")).select(F.col("id").alias("from_page_id")), "from_page_id", "left_semi")
    return [r[0] for r in on.select("from_page_id").distinct().orderBy("from_page_id").limit(n).collect()]


def reachable(pages: DataFrame, links: DataFrame, start_id: int | list[int], max_depth: int, follow_nofollow: bool = False) -> DataFrame:
    """(url, depth) of what in-scope links reach from a page, or from several, each at its least depth.

    Every round is written, so lineage stays short and lost executors cost one round.
    """
    work = Folder(pages.sparkSession, "reach")
    on = links.where("in_scope").join(pages.select(F.col("id").alias("f"), F.col("url").alias("src"), F.col("nofollow").alias("page_nofollow")), F.col("from_page_id") == F.col("f"))
    if not follow_nofollow:
        on = on.where(~F.col("nofollow") & ~F.col("page_nofollow"))
    edges = work.save(on.select("src", F.col("to_url").alias("dst")).distinct(), "edges")
    wave = work.save(pages.where(F.col("id").isin(start_id)).select("url", F.lit(0).alias("depth")), "wave0")
    seen = wave
    for depth in range(1, max_depth + 1):
        found = edges.join(wave.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        wave = work.save(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), f"wave{depth}")
        seen = seen.unionByName(wave)
        if wave.isEmpty():
            break
    return seen

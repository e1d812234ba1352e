"""The aggregates of a report. Each takes pages that classify() has prepared, of one crawl or of several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .pages import broken

SAMPLES, SECTIONS, REDIRECTS, ERRORS, BROKEN, TITLES, TOP, SCANNED = 10, 50, 30, 20, 20, 20, 10, 5000
_COUNTS = ("total", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "errors", "blocked", "noindex", "ms", "answers")


def classify(pages: DataFrame) -> DataFrame:
    """pages with language, section and status_key; the segments are a column of their own, so that they are split once."""
    split = pages.withColumn("_segments", U.segments(F.col("url")))
    segs = F.col("_segments")
    return split.withColumns({"language": U.language(segs), "section": U.section(segs), "status_key": X.status_key()}).drop("_segments")


def _bucket_counts() -> list:
    n = F.count_if
    values = (F.count("*"), *(n(X.in_class(k)) for k in (2, 3, 4, 5)), n(X.is_failed()), n(F.col("blocked")), n(F.col("noindex")), F.sum(F.when(X.has_response(), F.col("duration_ms")).otherwise(0)), n(X.has_response()))
    return [v.alias(k) for k, v in zip(_COUNTS, values)]


def averaged(counts: DataFrame) -> DataFrame:
    return counts.withColumn("avg_ms", X.int_avg(F.col("ms"), F.col("answers"))).drop("ms", "answers")


def buckets(pages: DataFrame, key: str) -> DataFrame:
    """Counts by crawl and key (depth or language)."""
    return averaged(pages.groupBy("crawl_id", F.col(key).cast("string").alias("key")).agg(*_bucket_counts()))


#: What a report counts by, in this order in the sets of all_counts(); the last set is all pages.
BREAKDOWNS = ("depth", "language", "section", "status_key", "content_type")


def all_counts(pages: DataFrame) -> DataFrame:
    """The counts by crawl and each of BREAKDOWNS, and of all pages, in one pass: part, crawl_id, key and counts."""
    sets = [["crawl_id", c] for c in BREAKDOWNS] + [["crawl_id"]]
    grouped = pages.groupingSets(sets, "crawl_id", *BREAKDOWNS).agg(F.grouping_id().alias("gid"), *_bucket_counts(), F.count_if("via_nofollow").alias("via_nofollow"), F.count_if(X.is_broken()).alias("broken"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    n = len(BREAKDOWNS)
    part = F.lit("all")
    key = F.lit("")
    for i, c in enumerate(BREAKDOWNS):  # a bit a column that is not in the set
        here = F.col("gid") == (1 << n) - 1 - (1 << n - 1 - i)
        part, key = F.when(here, c).otherwise(part), F.when(here, F.col(c).cast("string")).otherwise(key)
    return grouped.select(part.alias("part"), "crawl_id", key.alias("key"), *_COUNTS, "via_nofollow", "broken", "max_depth")


def section_buckets(pages: DataFrame, most: int = SECTIONS) -> DataFrame:
    """Counts of the largest sections, the others in one row whose average is of their sums."""
    return ranked_sections(pages.groupBy("crawl_id", F.col("section").alias("key")).agg(*_bucket_counts()), most)


def ranked_sections(counts: DataFrame, most: int = SECTIONS) -> DataFrame:
    """section_buckets() of counts by section: ranks are of the aggregated sections, not of pages."""
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("crawl_id").orderBy(F.desc("total"), "key")))
    rest = F.count_if(F.col("rank") > most).over(W.partitionBy("crawl_id"))
    named = ranked.withColumn("key", F.when(F.col("rank") > most, F.concat(F.lit("(otras "), rest.cast("string"), F.lit(" secciones)"))).otherwise(F.col("key")))
    return averaged(named.groupBy("crawl_id", "key", F.least("rank", F.lit(most + 1)).alias("rank")).agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", "status_key").agg(F.count("*").alias("n"))


def redirects(pages: DataFrame) -> DataFrame:
    """Redirect patterns with the pages of least id as their samples."""
    moved = pages.where(X.in_class(3) & (F.col("redirect_to") != "")).select("crawl_id", "id", "url", "redirect_to")
    moved = moved.withColumn("pattern", U.redirect_pattern(F.col("url"), F.col("redirect_to")))
    return moved.groupBy("crawl_id", "pattern").agg(F.count("*").alias("n"), F.min_by("url", "id").alias("sample_from"), F.min_by("redirect_to", "id").alias("sample_to"))


def errors(pages: DataFrame) -> DataFrame:
    failed = pages.where(X.is_failed()).withColumn("kind", X.error_kind(F.col("error"), F.col("url")))
    return failed.groupBy("crawl_id", "kind").agg(F.count("*").alias("n"), F.min_by("url", "id").alias("sample_url"))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles of several HTML pages; title and sample are those of the second page by id.

    The window keeps two rows a title before the shuffle; counts are aggregated apart.
    """
    named = pages.where(X.in_class(2) & F.col("content_type").startswith("text/html")).select("crawl_id", "id", "url", "title", X.normalize_title(F.col("title")).alias("norm")).where("norm <> ''")
    counts = named.groupBy("crawl_id", "norm").agg(F.count("*").alias("n")).where("n >= 2")
    w = W.partitionBy("crawl_id", "norm").orderBy("id")
    second = named.withColumn("rn", F.row_number().over(w)).where("rn <= 2").where("rn = 2")
    return second.join(counts, ["crawl_id", "norm"]).select("crawl_id", X.collapse_spaces(F.col("title")).alias("title"), "n", F.col("url").alias("sample_url"))


def page_ref() -> list:
    extra = F.when(X.in_class(3) & (F.col("redirect_to") != ""), F.col("redirect_to")).when(X.is_failed(), F.col("error")).when(F.col("noindex"), F.col("meta_robots")).otherwise("")
    return [F.col(c) for c in ("crawl_id", "url", "status", "duration_ms", "size", "depth")] + [extra.alias("extra")]


def top_pages(pages: DataFrame, by: str, n: int = TOP) -> DataFrame:
    """The n pages of each crawl that are largest by a column, url at ties."""
    w = W.partitionBy("crawl_id").orderBy(F.desc(by), "url")
    return pages.where(X.has_response()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*page_ref(), "rank")


def top_broken(pages: DataFrame, links: DataFrame, scanned: int = SCANNED, n: int = BROKEN, one_crawl: bool = False) -> DataFrame:
    """Of each crawl's first broken pages by url, those with the most referrers. one_crawl: the pages are of one, so `scanned` bounds them."""
    by_url = W.partitionBy("crawl_id").orderBy("url")
    some = pages.where(X.is_broken()).withColumn("at", F.row_number().over(by_url)).where(F.col("at") <= scanned)
    w = W.partitionBy("crawl_id").orderBy(F.desc("referrers_count"), "url")
    return broken(some, links, few=one_crawl).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("crawl_id", "url", "status", "error", "referrers_count", "rank")


def sample_keys():
    keys = [F.when(X.in_class(k), f"{k}xx") for k in (3, 4, 5)] + [F.when(X.is_failed(), "error")] + [F.when(F.col(k), k) for k in ("blocked", "noindex", "via_nofollow")]
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def samples(pages: DataFrame, seed: int = 0, n: int = SAMPLES) -> DataFrame:
    """Up to n pages of each class a page may be in, by a seeded hash: a uniform sample that any engine repeats."""
    w = W.partitionBy("crawl_id", "key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    each = pages.withColumn("key", F.explode(sample_keys()))
    return each.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("key", *page_ref(), "rn")

"""Listings, lookups, counters and corrections over pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

LINK_LIMIT = 500
MAX_LIMIT, DEFAULT_LIMIT = 1000, 100
FILTERS = ("", "2xx", "3xx", "4xx", "5xx", "error", "blocked", "via_nofollow")


class NotFound(LookupError):
    pass


def clamp_limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def status_filter(status: str):
    """The predicate of a listing's status filter."""
    if status not in FILTERS:
        raise ValueError(f"status no válido: {status}")
    if status == "":
        return F.lit(True)
    if status == "error":
        return X.is_failed()
    if status in ("blocked", "via_nofollow"):
        return F.col(status)
    return X.in_class(int(status[0]))


def matching(pages: DataFrame, crawl_id: int, status: str = "", q: str = "") -> DataFrame:
    out = pages.where((F.col("crawl_id") == crawl_id) & status_filter(status))
    return out.where(X.contains_ascii_ci(F.col("url"), q) | X.contains_ascii_ci(F.col("title"), q)) if q else out


def list_pages(pages: DataFrame, crawl_id: int, status: str = "", q: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """One page of the matches in order of id."""
    return matching(pages, crawl_id, status, q).orderBy("id").offset(max(0, offset)).limit(clamp_limit(limit))


def page_range(offset: int, count: int, total: int, limit: int = DEFAULT_LIMIT) -> tuple[str, bool, bool]:
    """What a page of a listing shows (`1–100 de 2.500`), and whether there are pages before and after it."""
    if total <= 0:
        return "0", False, False
    label = f"{X.grouped(offset + 1)}–{X.grouped(min(offset + count, total))} de {X.grouped(total)}"
    return label, offset > 0, offset + limit < total


def all_in_pages(fetch, size: int = MAX_LIMIT):
    """All rows of a listing, taken page by page: fetch(limit, offset) gives a page's rows."""
    offset = 0
    while rows := fetch(size, offset):
        yield from rows
        if len(rows) < size:
            return
        offset += size


def find_page(pages: DataFrame, crawl_id: int, **key) -> DataFrame:
    """The row with a given id or url."""
    (name, value), = key.items()
    return pages.where((F.col("crawl_id") == crawl_id) & (F.col(name) == value))


def counters() -> list:
    n = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count("*").alias("total"),
        *(n(X.in_class(k), f"status_{k}xx") for k in (2, 3, 4, 5)),
        n(X.is_failed(), "errors"),
        n(F.col("blocked"), "blocked"),
        n(F.col("noindex"), "noindex"),
        n(F.col("via_nofollow"), "via_nofollow"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum(F.when(X.has_response(), F.col("duration_ms"))), F.lit(0)).alias("duration_sum"),
        n(X.has_response(), "duration_n"),
    ]


def summary(pages: DataFrame) -> DataFrame:
    """One row of counters; an empty crawl has zeros."""
    return pages.agg(*counters()).withColumn("avg_duration_ms", X.int_avg(F.col("duration_sum"), F.col("duration_n"))).drop("duration_sum", "duration_n")


def filter_totals(pages: DataFrame) -> DataFrame:
    """(filter, total) of every status filter, in one pass."""
    names = [f or "all" for f in FILTERS]
    row = pages.agg(*(F.count_if(status_filter(f)).alias(n) for f, n in zip(FILTERS, names)))
    return row.unpivot([], names, "filter", "total")


def content_types(pages: DataFrame) -> DataFrame:
    return pages.where("content_type <> ''").groupBy("crawl_id", "content_type").agg(F.count("*").alias("n"))


def in_degrees(links: DataFrame) -> DataFrame:
    """Link rows by destination."""
    return links.groupBy("crawl_id", "to_url").agg(F.count("*").alias("n"))


def broken(pages: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """Broken pages with the number of link rows that lead to them.

    Links are counted before they meet pages, in the map tasks first, so a popular target is a
    row a task in the shuffle. few: the pages are at most some thousands, as a cut page is;
    then links are first reduced to those that lead to them, by a broadcast of their URLs.
    """
    bad = pages.where(X.is_broken())
    to = links.select("crawl_id", F.col("to_url").alias("url"))
    if few:
        to = to.join(F.broadcast(bad.select("crawl_id", "url")), ["crawl_id", "url"], "left_semi")
    n = to.groupBy("crawl_id", "url").agg(F.count("*").alias("referrers_count"))
    return bad.join(n, ["crawl_id", "url"], "left").withColumn("referrers_count", F.coalesce("referrers_count", F.lit(0)))


def broken_page(pages: DataFrame, links: DataFrame, crawl_id: int, limit: int = 0, offset: int = 0) -> DataFrame:
    """Broken pages of a crawl by url. The page is cut first, and only links to its rows are counted."""
    some = pages.where((F.col("crawl_id") == crawl_id) & X.is_broken()).orderBy("url").offset(max(0, offset)).limit(clamp_limit(limit))
    return broken(some, links.where(F.col("crawl_id") == crawl_id), few=True).orderBy("url")


def inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the url of the page they are on."""
    sources = pages.select(F.col("crawl_id").alias("c"), F.col("id").alias("from_id"), F.col("url").alias("from_url"))
    return links.join(sources, (F.col("crawl_id") == F.col("c")) & (F.col("from_page_id") == F.col("from_id"))).drop("c", "from_id")


def referrers(pages: DataFrame, links: DataFrame, targets: DataFrame | None = None, per_url: int = 3) -> DataFrame:
    """The first per_url links to each target (crawl_id, to_url), by id. The window keeps so many rows a key before the shuffle."""
    if targets is not None:
        links = links.join(targets.select("crawl_id", "to_url"), ["crawl_id", "to_url"], "left_semi")
    first = links.withColumn("rn", F.row_number().over(W.partitionBy("crawl_id", "to_url").orderBy("id"))).where(F.col("rn") <= (per_url if per_url > 0 else 3))
    return inlinks(pages, first)


def broken_with_referrers(pages: DataFrame, links: DataFrame, per_url: int = 3) -> DataFrame:
    """Broken pages with the number of links to them and an array of their first referrers.

    Links are read and moved once: those to a broken page are counted and ranked where they meet it, so a
    popular one's are in one task, which spills. A referrer that is not among the pages counts but has no url.
    """
    bad = pages.where(X.is_broken())
    target = W.partitionBy("crawl_id", "to_url")
    to = links.select("crawl_id", "to_url", "id", "from_page_id").join(bad.select("crawl_id", F.col("url").alias("to_url")), ["crawl_id", "to_url"], "left_semi")
    ranked = to.withColumns({"rn": F.row_number().over(target.orderBy("id")), "n": F.count("*").over(target)})
    first = ranked.where(F.col("rn") <= (per_url if per_url > 0 else 3))
    sources = pages.select(F.col("crawl_id").alias("c"), F.col("id").alias("from_id"), F.col("url").alias("from_url"))
    some = first.join(sources, (F.col("crawl_id") == F.col("c")) & (F.col("from_page_id") == F.col("from_id")), "left")
    shown = F.collect_list(F.when(F.col("from_url").isNotNull(), F.struct("rn", "from_url")))
    nested = some.groupBy("crawl_id", F.col("to_url").alias("url")).agg(F.max("n").alias("referrers_count"), F.transform(F.sort_array(shown), lambda x: x["from_url"]).alias("referrers"))
    return bad.join(nested, ["crawl_id", "url"], "left").withColumns({"referrers_count": F.coalesce("referrers_count", F.lit(0)), "referrers": F.coalesce("referrers", F.array().cast("array<string>"))})


def page_outlinks(links: DataFrame, crawl_id: int, page_id: int) -> DataFrame:
    return links.where((F.col("crawl_id") == crawl_id) & (F.col("from_page_id") == page_id)).orderBy("id").limit(LINK_LIMIT)


def page_inlinks(pages: DataFrame, links: DataFrame, crawl_id: int, url: str) -> DataFrame:
    some = links.where((F.col("crawl_id") == crawl_id) & (F.col("to_url") == url)).orderBy("id").limit(LINK_LIMIT)
    return inlinks(pages.where(F.col("crawl_id") == crawl_id), some).orderBy("id")


def degrees(pages: DataFrame, links: DataFrame) -> DataFrame:
    """In- and out-degree of every page, in link rows."""
    out = links.groupBy("crawl_id", F.col("from_page_id").alias("id")).agg(F.count("*").alias("out_links"))
    into = in_degrees(links).withColumnsRenamed({"to_url": "url", "n": "in_links"})
    joined = pages.select("crawl_id", "id", "url").join(out, ["crawl_id", "id"], "left").join(into, ["crawl_id", "url"], "left")
    return joined.select("crawl_id", "id", "url", F.coalesce("in_links", F.lit(0)).alias("in_links"), F.coalesce("out_links", F.lit(0)).alias("out_links"))


def recompute_via_nofollow(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages with via_nofollow cleared where a normal link on a page without nofollow leads there. Idempotent."""
    good = links.where(~F.col("nofollow")).join(pages.where(~F.col("nofollow")).select(F.col("crawl_id").alias("c"), F.col("id").alias("f")), (F.col("crawl_id") == F.col("c")) & (F.col("from_page_id") == F.col("f")), "left_semi")
    reached = good.select("crawl_id", F.col("to_url").alias("url")).distinct().withColumn("reached", F.lit(True))
    return pages.join(reached, ["crawl_id", "url"], "left").withColumn("via_nofollow", F.col("via_nofollow") & F.col("reached").isNull()).select(*pages.columns)

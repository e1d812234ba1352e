"""Breadth-first crawl as rounds of DataFrames.

A wave is all that is queued when a round begins. Its items have an order (seq: the order
in which a single worker would take them). A round checks robots, cuts the wave at the
page budget, joins responses, parses, and makes the next wave of what the pages discover
and no earlier wave has seen. Waves, pages and seen URLs are written every round; what a round
finds is dealt by hash and meets the seen URLs bucket beside bucket, so these are never shuffled.

The seed's redirects and the sitemaps are read first, one response at a time: they are a
handful of URLs that decide the host, the robots.txt and the base of everything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import robots as B
from .functions import urls as U
from .functions.html import parse_html
from .functions.normalize import InvalidURL, host_of, normalize, same_site, split, try_normalize
from .schema import CRAWLED
from .sources.shared import Folder
from .sources.url_runs import UrlRuns, hashes
from .sources.sitemaps import MOST_LEVELS, MOST_URLS, read_sitemap, unpacked

MOST_HOST_HOPS = 5
_PAGES_LEAST, _PAGES_MOST = 100, 20_000  # pages that a task parses
HTML_TYPES = ("text/html", "application/xhtml+xml")


@dataclass
class Stats:
    fetched: int = 0
    blocked: int = 0
    errors: int = 0
    queued: int = 0
    sitemaps: int = 0
    via_nofollow: int = 0
    delay_ms: int = 0
    final_host: str = ""
    robots_txt: str = ""
    robots_error: str = ""


@dataclass
class Crawl:
    pages: DataFrame  # CRAWLED, seq in order of crawling
    stats: Stats
    robots: B.Robots = field(default_factory=B.Robots)


def _request_path(url: str) -> str:
    _, _, path, query = split(url)
    return (path or "/") + (f"?{query}" if query else "")


def build_page(r: dict, depth: int, host: str, config: Config) -> dict:
    """A page from one response."""
    page = {f.name: "" for f in CRAWLED.fields if f.dataType.simpleString() == "string"}
    page |= {"url": r["url"], "depth": depth, "status": 0, "size": 0, "duration_ms": 0, "noindex": False, "nofollow": False, "via_nofollow": False, "blocked": False, "links": [], "fetched_at": pd.Timestamp.utcnow().tz_localize(None)}
    if r["fetch_error"]:
        return page | {"error": r["fetch_error"]}
    content_type = r["content_type"].split(";")[0].strip().lower()
    noindex, nofollow = B.directives(r["x_robots_tag"], config.robots_token)
    page |= {"status": int(r["status"]), "size": int(r["size"]), "duration_ms": int(r["duration_ms"]), "content_type": content_type, "x_robots_tag": r["x_robots_tag"], "noindex": noindex, "nofollow": nofollow}
    if 300 <= page["status"] < 400:
        return page | {"redirect_to": (try_normalize(r["location"], r["url"]) if r["location"] else None) or ""}
    if content_type in HTML_TYPES:
        found = parse_html(bytes(r["body"] or b"").decode("utf-8", "replace"), r["url"], host, config.include_subdomains)
        found["noindex"], found["nofollow"] = found["noindex"] or noindex, found["nofollow"] or nofollow
        page |= found
    return page


def _blocked(url: str, depth: int, reason: str) -> dict:
    return build_page({"url": url, "fetch_error": reason or "-"}, depth, "", Config()) | {"error": reason, "blocked": True}


def nth(rows: DataFrame, n: int, digit: int = 11) -> int:
    """The n-th smallest seq of rows, of which there are n at least, without a sort: counts by leading bits, then by the next ones below the prefix that holds it.

    The first counts are a row a range partition of the wave, the others 2^digit rows at most.
    """
    prefix, at = None, 33
    while True:
        counts = rows.groupBy(F.shiftright("seq", at).alias("p")).count().collect()
        for p, count in sorted(map(tuple, counts)):
            if count >= n:
                prefix = p
                break
            n -= count
        if not at:
            return prefix
        rows, at = rows.where(F.shiftright("seq", at) == prefix), max(0, at - digit)


class Cancelled(Exception):
    """A crawl was told to stop; the pages of its finished rounds have been given out."""


class Engine:
    """sink(pages) gets pages as soon as they are written: those of a round, or of a slice of it; stopped() is asked before each.

    A slice has flush_pages pages at most and, at the rate that the crawl's delay allows, takes flush_seconds
    (by default the fetcher's; one that answers at once has none, and its rounds are not cut).
    """

    def __init__(self, spark: SparkSession, config: Config, fetcher, sink=None, stopped=None, flush_pages: int | None = None, flush_seconds: float | None = None):
        self.spark, self.config, self.fetcher = spark, config.with_defaults(), fetcher
        self.sink, self.stopped = sink or (lambda pages: None), stopped or (lambda: False)
        if errors := self.config.validate():
            raise ValueError("; ".join(errors))
        self.work, self.flush_pages = Folder(spark, "crawl"), flush_pages
        self.flush_seconds = getattr(fetcher, "flush_seconds", None) if flush_seconds is None else flush_seconds
        self.stats = Stats(delay_ms=self.config.delay_ms)

    def _one(self, url: str) -> dict:
        if one := getattr(self.fetcher, "fetch_one", None):
            return one(url).first().asDict()
        return self.fetcher.fetch(self.spark.createDataFrame([(url,)], "url string")).first().asDict()

    def _robots(self, base: str) -> B.Robots:
        """The rules of an origin; the crawl goes on with the longer of its delay and the one they ask for."""
        robots = self._rules(base)
        asked = round(1000 * robots.crawl_delay(self.config.robots_token))
        self.stats.delay_ms = max(self.stats.delay_ms, asked)
        self.fetcher.pace(self.stats.delay_ms)
        return robots

    def _rules(self, base: str) -> B.Robots:
        if self.config.ignore_robots:
            return B.Robots()
        scheme, authority, _, _ = split(base)
        r = self._one(f"{scheme}://{authority}/robots.txt")
        if r["fetch_error"]:
            self.stats.robots_error = f"robots.txt: {r['fetch_error']}"
            return B.Robots(disallow_all=True, reason=self.stats.robots_error)
        text = bytes(r["body"] or b"").decode("utf-8", "replace")
        self.stats.robots_txt, self.stats.robots_error = text, ""
        if r["status"] >= 500:
            self.stats.robots_error = f"robots.txt: HTTP {r['status']}"
            return B.Robots(disallow_all=True, reason=self.stats.robots_error)
        return B.parse_robots(text) if 200 <= r["status"] < 300 else B.Robots()

    def _seed_chain(self, url: str) -> tuple[list[dict], str, B.Robots, str, list[tuple[str, int, bool]]]:
        """Pages of the seed and its redirects, the host, robots and base they lead to, and what they queue."""
        c, pages, hops, base = self.config, [], 0, url
        robots, host, seen = self._robots(url), host_of(url), set()
        while True:
            if self.stats.fetched >= c.max_pages:
                return pages, host, robots, base, [(url, 0, False)]
            seen.add(url)
            if not robots.allowed(c.robots_token, _request_path(url)):
                self.stats.blocked += 1
                pages.append(_blocked(url, 0, robots.reason))
                return pages, host, robots, base, []
            page = build_page(self._one(url), 0, host, c)
            pages.append(page)
            self.stats.fetched += 1
            self.stats.errors += bool(page["error"])
            target = page["redirect_to"]
            if not target:
                return pages, host, robots, base, [] if page["error"] else self._found(page)
            if target in seen:
                return pages, host, robots, base, []
            if not same_site(host, host_of(target), c.include_subdomains):
                if hops >= MOST_HOST_HOPS:
                    return pages, host, robots, base, []
                hops += 1
                host, base, robots = host_of(target), target, self._robots(target)
            url = target

    def _found(self, page: dict) -> list[tuple[str, int, bool]]:
        out = []
        if page["depth"] + 1 <= self.config.max_depth:
            for link in page["links"]:
                via = link["nofollow"] or page["nofollow"]
                if link["in_scope"] and (not via or self.config.follow_nofollow):
                    out.append((link["url"], page["depth"] + 1, via))
        return out

    def _sitemaps(self, robots: B.Robots, base: str, host: str) -> list[tuple[str, int, bool]]:
        if not self.config.use_sitemaps or self.config.ignore_robots:
            return []
        out, count = [], 0

        def visit(location: str, level: int) -> None:
            nonlocal count
            url = try_normalize(location, base) if level <= MOST_LEVELS and count < MOST_URLS else None
            if url is None or (r := self._one(url))["fetch_error"]:
                return
            body = unpacked(bytes(r["body"] or b""), url)
            if body is None:
                return
            indexes, urls = read_sitemap(body)
            for x in indexes:
                if x and count < MOST_URLS:
                    visit(x, level + 1)
            urls = urls[: MOST_URLS - count]
            count += len(urls)
            for x in urls:
                u = try_normalize(x, base) if x else None
                if u and same_site(host, host_of(u), self.config.include_subdomains):
                    out.append((u, 1, False))

        for x in robots.sitemaps:
            visit(x, 1)
        self.stats.sitemaps = count
        return out

    def _tasks(self, n: int) -> int:
        """How many tasks parse n pages: all cores have some of a wave, however few bytes it has, and no task has too many."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, min(-(-n // _PAGES_LEAST), 4 * cores), -(-n // _PAGES_MOST))

    def _parsed(self, wave: DataFrame, host: str, n: int) -> DataFrame:
        """The pages of a wave's items (seq, url, depth, ...), n at most."""
        config = self.config

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [build_page(r, r["depth"], host, config) | {"seq": r["seq"]} for r in b.to_dict("records")]
                yield pd.DataFrame(rows, columns=CRAWLED.fieldNames())

        answers = self.fetcher.fetch(wave.select("url"))
        # parsing costs far more than its bytes tell, by which adaptive execution would put a wave into a task or two
        return wave.select("seq", "url", "depth").join(answers, "url").repartition(self._tasks(n), "seq").mapInPandas(run, CRAWLED)

    def run(self) -> Crawl:
        c, s, work = self.config, self.stats, self.work
        try:
            seed = normalize(c.seed)
        except InvalidURL as e:
            raise ValueError(f"invalid seed: {e}") from e
        chain, host, robots, base, queued = self._seed_chain(seed)
        s.final_host = host
        queue = self._sitemaps(robots, base, host)
        # the chain's links were queued before the sitemaps' URLs
        order: dict[str, list] = {}
        for url, depth, via in queued + queue:
            order.setdefault(url, [depth, via])[1] &= via
        done = {p["url"] for p in chain}
        first = [(i, u, d, v) for i, (u, (d, v)) in enumerate(order.items()) if u not in done]
        rows = [p | {"seq": i} for i, p in enumerate(chain)]
        pages = [work.save(self.spark.createDataFrame(pd.DataFrame(rows, columns=CRAWLED.fieldNames()), CRAWLED), "pages0")]
        self.sink(pages[0])
        wave = work.save(self.spark.createDataFrame(first, "seq long, url string, depth int, mark boolean"), "wave0")
        seen = UrlRuns(self.spark, f"{work.path}/seen")
        try:
            return self._rounds(pages, wave, done, seen, host, robots)
        finally:
            seen.close()

    def _rounds(self, pages: list[DataFrame], wave: DataFrame, done: set[str], seen: UrlRuns, host: str, robots: B.Robots) -> Crawl:
        c, s, work = self.config, self.stats, self.work
        first = self.spark.createDataFrame([(u,) for u in done], "url string").unionByName(wave.select("url"))
        seen.add(first.select(*hashes(F.col("url"))).repartition(seen.buckets, "h1", "h2"))
        base_seq, number = 1 << 32, 0
        while not wave.isEmpty():
            if self.stopped():
                raise Cancelled(f"after {s.fetched} pages")
            number += 1
            checked = wave.withColumn("allowed", self._allowed(robots))
            budget = c.max_pages - s.fetched
            n_allowed = checked.where("allowed").count()
            taken = checked
            if budget <= 0:
                taken = checked.limit(0)
            elif n_allowed >= budget:  # nothing is taken after the item that uses the budget up
                taken = checked.where(F.col("seq") <= nth(checked.where("allowed"), budget))
            fetched = []
            n_taken = min(n_allowed, max(0, budget))
            for k, part in enumerate(self._slices(taken.where("allowed"), n_taken, number)):
                if k and self.stopped():
                    raise Cancelled(f"after {s.fetched} pages")
                fetched.append(work.save(self._parsed(part, host, n_taken), f"fetched{number}-{k}"))
                found = self._discovered(reduce(DataFrame.unionByName, fetched), host)
                # an item keeps its mark unless an earlier item of the wave has a normal link to it
                cleared = found.where("not nf").groupBy("url").agg(F.min("i").alias("by"))
                marks = part.select("seq", "url", "mark").join(cleared, "url", "left").select("seq", (F.col("mark") & ~F.coalesce(F.col("by") < F.col("seq"), F.lit(False))).alias("via_nofollow"))
                page = fetched[-1].drop("via_nofollow").join(marks, "seq").select(*CRAWLED.fieldNames())
                if not k:
                    page = page.unionByName(taken.where("not allowed").select(*(self._blank(f, robots.reason) for f in CRAWLED.fields)))
                page = work.save(page.withColumn("seq", F.col("seq") + base_seq * number), f"pages{number}-{k}")
                pages.append(page)
                self.sink(page)
                got = page.agg(F.count_if(~F.col("blocked")), F.count_if("blocked"), F.count_if((F.col("error") != "") & ~F.col("blocked")), F.count_if("via_nofollow")).first()
                s.fetched, s.blocked, s.errors, s.via_nofollow = s.fetched + got[0], s.blocked + got[1], s.errors + got[2], s.via_nofollow + got[3]
            keyed = found.select("i", "j", "depth", "nf", "url", *hashes(F.col("url")))
            fresh = keyed.groupBy("h1", "h2").agg(F.min(F.struct("i", "j", "depth", "url")).alias("x"), F.min("nf").alias("nf"))
            with seen.settings():
                # ids ascend through the range-partitioned order
                ordered = seen.absent(fresh).select("h1", "h2", "x.*", F.col("nf").alias("mark")).orderBy("i", "j")
                wave = work.save(ordered.select(F.monotonically_increasing_id().alias("seq"), "url", "depth", "mark", "h1", "h2"), f"wave{number}")
            seen.add(wave.select("h1", "h2").repartition(seen.buckets, "h1", "h2"))
            left = checked.join(taken.select("seq"), "seq", "left_anti")
            if budget - n_allowed <= 0:
                s.queued = left.count() + wave.count()
                break
        out = pages[0]
        for p in pages[1:]:
            out = out.unionByName(p)
        return Crawl(out, s, robots)

    def _slices(self, items: DataFrame, n: int, number: int) -> list[DataFrame]:
        """The n items of a wave that are fetched, in order, as slices whose pages are given out one after the other."""
        per = self.flush_pages or n
        if self.stats.delay_ms and self.flush_seconds:
            per = min(per, max(1, round(1000 * self.flush_seconds / self.stats.delay_ms)))
        if n <= per:
            return [items]
        at = self.work.save(self.work.numbered(items, f"order{number}", "seq").withColumn("slice", F.floor((F.col("n") - 1) / per)), f"sliced{number}")
        return [at.where(F.col("slice") == k) for k in range(-(-n // per))]

    @staticmethod
    def _blank(f, reason: str):
        kind = f.dataType.simpleString()
        if f.name in ("seq", "url", "depth"):
            return F.col(f.name)
        value = {"error": F.lit(reason), "blocked": F.lit(True), "fetched_at": F.current_timestamp()}.get(f.name)
        if value is None:
            value = F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.array() if kind.startswith("array") else F.lit(0)
        return value.cast(f.dataType).alias(f.name)

    def _allowed(self, robots: B.Robots):
        if robots.disallow_all:
            return F.lit(False)
        group = robots.group(self.config.robots_token)
        return B.allowed_by_rules(U.robots_path(F.col("url")), group.rules if group else [])

    def _discovered(self, pages: DataFrame, host: str) -> DataFrame:
        """(i, j, url, depth, nf): what pages lead to, links in order, then the redirect."""
        c = self.config
        ok = pages.where("error = ''")
        link = ok.where(F.col("depth") + 1 <= c.max_depth).select(F.col("seq").alias("i"), (F.col("depth") + 1).alias("depth"), "nofollow", F.posexplode("links").alias("j", "l"))
        link = link.where("l.in_scope").select("i", "j", "l.url", "depth", (F.col("l.nofollow") | F.col("nofollow")).alias("nf"))
        if not c.follow_nofollow:
            link = link.where("not nf")
        inside = U.same_site(host, U.host(F.col("redirect_to")), c.include_subdomains)
        moved = ok.where((F.col("redirect_to") != "") & inside).select(F.col("seq").alias("i"), F.lit(2**31 - 1).alias("j"), F.col("redirect_to").alias("url"), "depth", F.lit(False).alias("nf"))
        return link.unionByName(moved)


def run(spark: SparkSession, config: Config, fetcher, sink=None, stopped=None, **flush) -> Crawl:
    return Engine(spark, config, fetcher, sink, stopped, **flush).run()

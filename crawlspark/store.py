"""A store of crawls as Parquet tables in one folder.

pages and links are partitioned by crawl and version, counters by crawl. A batch counts once
its marker row is in `batches`, so a batch is visible whole or not at all; its number is
claimed before anything is written, so what a broken batch left is never taken for another's.
The control table of crawls is small and is written anew with every change; it says which
version of a crawl's pages and links holds. A change reads the newest table, writes what follows
from it to a folder of its own, and takes the next number for that folder. If another process was
first, the change is made anew on what that one left, so none is lost and conditions (only a
running crawl finishes) hold when they count. Tables that were replaced stay for `_KEPT` seconds for
who is reading them. Pages of one crawl are to be added by one process at a time.

Each batch leaves its counters, so a summary adds up a row a batch and reads no page, and the
hashes of its URLs as a run (url_runs.py), so what is new is told without reading the crawl. Runs name
the batches that they are of: those of a batch that broke are taken out, those that are missing are made.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crawl import Cancelled, Engine, nth
from .functions import text as X
from .operators import pages as P
from .plans import report as report_plan
from .schema import ADDED, CRAWLS, LINKS, PAGES
from .sources.exclusive import Exclusive
from .sources.shared import Folder
from .sources.url_runs import UrlRuns, hashes

NotFound = P.NotFound
_BATCHES = "batch long, n long, crawl_id long"
_SHIFT = 40  # ids: batch, then number within it
_SORTED = 20_000  # up to so many rows before a page are sorted with it
_KEPT = 3600  # seconds that replaced control tables and taken numbers stay
_TRIES = 100


class Conflict(RuntimeError):
    """Another process changed what a change was based on."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._url_runs: dict[int, UrlRuns] = {}
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._control = Exclusive(spark, f"{self.path}/control")
        self._numbers = Exclusive(spark, f"{self.path}/numbers")
        self.check_writable()
        self.migrate()
        # what was running when the last process ended has failed
        self._change(self._interrupted)
        self._numbers.forget(self._last_batch(), 24 * _KEPT)

    @staticmethod
    def _interrupted(crawls: DataFrame) -> DataFrame | None:
        ran = F.col("status") == "running"
        if crawls.where(ran).isEmpty():
            return None
        return crawls.withColumns({"error": F.when(ran, "interrumpido").otherwise(F.col("error")), "finished_at": F.when(ran, F.current_timestamp()).otherwise(F.col("finished_at")), "status": F.when(ran, "failed").otherwise(F.col("status"))})

    def check_writable(self) -> None:
        """The folder is made if it is not there; PermissionError if nothing can be written to it."""
        probe = self._path(f"{self.path}/.probe-{uuid.uuid4().hex}")
        try:
            self._fs.mkdirs(probe.getParent())
            self._fs.create(probe).close()
            self._fs.delete(probe, False)
        except Exception as e:
            raise PermissionError(f"cannot write to {self.path}: {str(e).splitlines()[0]}") from e

    def migrate(self) -> list[str]:
        """Bring a store of an older version up to date: new columns of the control table, counters of batches that have none. Returns what was added."""
        added = []
        if folder := self.control_folder():
            have = set(self.spark.read.parquet(folder).columns)
            if missing := [c for c in CRAWLS.fieldNames() if c not in have]:
                self._change(lambda crawls: crawls)
                added += [f"crawls.{c}" for c in missing]
        if self._exists("batches"):
            without = self._done().join(self._counters().select("crawl_id", "batch"), ["crawl_id", "batch"], "left_anti").select("crawl_id", "batch").collect()
            for crawl_id in sorted({r.crawl_id for r in without}):
                batches = [r.batch for r in without if r.crawl_id == crawl_id]
                self._count(self.pages(crawl_id).withColumn("batch", F.shiftright("id", _SHIFT)).where(F.col("batch").isin(batches)), crawl_id)
                added += [f"counters {crawl_id}/{b}" for b in batches]
        return added

    # the control table
    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _newest(self) -> tuple[int, str | None]:
        """The number of the newest control table, and its folder."""
        if taken := self._control.taken():
            return (n := max(taken)), f"{self.path}/crawls/{self._control.text(n)}"
        if self._exists("crawls"):  # of a store before control tables had numbers of their own
            found = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/crawls"))]
            if v := [int(n[2:]) for n in found if n.startswith("v=") and self._exists(f"crawls/{n}/_SUCCESS")]:
                return max(v), f"{self.path}/crawls/v={max(v)}"
        return 0, None

    def control_folder(self) -> str | None:
        return self._newest()[1]

    @staticmethod
    def _filled(table: DataFrame, name: str) -> DataFrame:
        return table.fillna(ADDED.get(name, {}))

    def _crawls_in(self, folder: str | None) -> DataFrame:
        return self._filled(self.spark.read.schema(CRAWLS).parquet(folder), "crawls") if folder else self.spark.createDataFrame([], CRAWLS)

    def crawls(self) -> DataFrame:
        return self._crawls_in(self.control_folder())

    def _change(self, change) -> None:
        """Replace the control table by change(table), which may return None for no change; called anew when another process was first."""
        for _ in range(_TRIES):
            number, folder = self._newest()
            table = change(self._crawls_in(folder))
            if table is None:
                return
            new = f"t-{uuid.uuid4().hex}"
            table.coalesce(1).write.parquet(f"{self.path}/crawls/{new}")
            if self._control.take(number + 1, new):
                return self._tidy()
            self._fs.delete(self._path(f"{self.path}/crawls/{new}"), True)
        raise Conflict(f"control table of {self.path}: {_TRIES} times another change was first")

    def _tidy(self) -> None:
        """Delete control tables that were replaced, or never took a number, `_KEPT` seconds ago or longer."""
        self._control.forget(max(self._control.taken()), _KEPT)
        held = set()
        for n in self._control.taken():
            try:
                held.add(self._control.text(n))
            except Exception:  # noqa: BLE001  another process has just deleted it
                pass
        before = (datetime.now(timezone.utc).timestamp() - _KEPT) * 1000
        for x in self._fs.listStatus(self._path(f"{self.path}/crawls")):
            if x.getPath().getName() not in held and x.getModificationTime() < before:
                self._fs.delete(x.getPath(), True)

    def _update(self, crawl_id: int, when=None, **values) -> None:
        """Set columns of a crawl. when(row) is asked about the crawl as it is when the change counts: False leaves it so."""

        def change(crawls: DataFrame) -> DataFrame | None:
            row = crawls.where(F.col("id") == crawl_id).first()
            if row is None:
                raise NotFound(f"crawl {crawl_id}")
            if when is not None and not when(row):
                return None
            return crawls.withColumns({n: F.when(F.col("id") == crawl_id, v).otherwise(F.col(n)) for n, v in values.items()})

        self._change(change)

    def create_crawl(self, seed: str, config: str = "{}") -> int:
        new = 0

        def change(crawls: DataFrame) -> DataFrame:
            nonlocal new
            new = (crawls.agg(F.max("id")).first()[0] or 0) + 1
            return crawls.unionByName(self.spark.createDataFrame([(new, seed, "running", config, datetime.now(timezone.utc), None, "", "", 0, 0, 0)], CRAWLS))

        self._change(change)
        return new

    def get_crawl(self, crawl_id: int) -> dict:
        row = self.crawls().where(F.col("id") == crawl_id).first()
        if row is None:
            raise NotFound(f"crawl {crawl_id}")
        return row.asDict()

    def list_crawls(self) -> DataFrame:
        return self.crawls().orderBy(F.desc("started_at"), F.desc("id"))

    def set_robots(self, crawl_id: int, text: str) -> None:
        self._update(crawl_id, robots_txt=F.lit(text))

    def finish_crawl(self, crawl_id: int, status: str, error: str = "") -> None:
        """Only a running crawl changes; finishing one again does nothing."""
        self._update(crawl_id, lambda row: row.status == "running", finished_at=F.current_timestamp(), status=F.lit(status), error=F.lit(error))

    def delete_crawl(self, crawl_id: int) -> None:
        def change(crawls: DataFrame) -> DataFrame:
            if crawls.where(F.col("id") == crawl_id).isEmpty():
                raise NotFound(f"crawl {crawl_id}")
            return crawls.where(F.col("id") != crawl_id)

        self._change(change)
        if runs := self._url_runs.pop(crawl_id, None):
            runs.close()
        for name in ("batches", "counters", "pages", "links", "urls"):
            self._fs.delete(self._path(f"{self.path}/{name}/crawl_id={crawl_id}"), True)
        for name in ("pages", "links"):
            self._fs.delete(self._path(f"{self.path}/numbers/{name}-{crawl_id}"), True)

    # pages and links
    def _done(self) -> DataFrame:
        """(crawl_id, batch) of whole batches."""
        if not self._exists("batches"):
            return self.spark.createDataFrame([], "crawl_id long, batch long")
        return self.spark.read.schema(_BATCHES).parquet(f"{self.path}/batches").where("n >= 0").select("crawl_id", "batch")

    def _table(self, name: str, schema) -> DataFrame:
        if not self._exists(name) or not self._exists("batches"):
            return self.spark.createDataFrame([], schema)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", version int"
        t = self.spark.read.schema(columns).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        holds = self.crawls().select(F.col("id").alias("crawl_id"), F.col(f"{name}_version").alias("version"))
        t = t.join(holds, ["crawl_id", "version"], "left_semi").withColumn("batch", F.shiftright(F.col("id"), _SHIFT))
        return self._filled(t.join(self._done(), ["crawl_id", "batch"], "left_semi").select(*schema.fieldNames()), name)

    def pages(self, crawl_id: int | None = None) -> DataFrame:
        t = self._table("pages", PAGES)
        return t if crawl_id is None else t.where(F.col("crawl_id") == crawl_id)

    def links(self, crawl_id: int | None = None) -> DataFrame:
        t = self._table("links", LINKS)
        return t if crawl_id is None else t.where(F.col("crawl_id") == crawl_id)

    def _last_batch(self) -> int:
        return self.spark.read.schema(_BATCHES).parquet(f"{self.path}/batches").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] if self._exists("batches") else 0

    def _claim(self, crawl_id: int) -> int:
        """A batch number that no other batch has, whole or broken, of any process."""
        number = self._numbers.next(self._last_batch())
        self._mark(number, -1, crawl_id)
        return number

    def _mark(self, batch: int, n: int, crawl_id: int) -> None:
        # straight into the crawl's own folder: two writers to one folder take away each other's temporary files
        self.spark.range(0, 1, 1, 1).select(*(F.lit(x).cast("long").alias(c) for c, x in (("batch", batch), ("n", n)))).write.mode("append").parquet(f"{self.path}/batches/crawl_id={crawl_id}")

    #: Columns of which single values are looked up. Ids, by which files are sorted, have bounds.
    _LOOKUPS = {"pages": ("url",), "links": ("to_url",)}

    def _write(self, df: DataFrame, crawl_id: int, name: str, schema, version: int, mode: str = "append") -> None:
        """Rows of one crawl, under a version of its table."""
        cols = [F.col(f.name).cast(f.dataType) for f in schema.fields if f.name != "crawl_id"]
        writer = df.select(*cols).write.mode(mode)
        for column in self._LOOKUPS[name]:  # files whose filter has not the value are not read
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/{name}/crawl_id={crawl_id}/version={version}")

    def _urls(self, crawl_id: int) -> tuple[UrlRuns, set[int]]:
        """The URLs of a crawl's whole batches, and the numbers of these."""
        runs = self._url_runs.get(crawl_id)
        if runs is None or runs.stale():
            if runs is not None:
                runs.close()
            runs = self._url_runs[crawl_id] = UrlRuns(self.spark, f"{self.path}/urls/crawl_id={crawl_id}")
        done = {r.batch for r in self._done().where(F.col("crawl_id") == crawl_id).select("batch").collect()}
        have = runs.tags()
        runs.drop(have - done)
        if missing := sorted(done - have):  # of an older version, or stopped before its run was written
            some = self.pages(crawl_id).where(F.shiftright("id", _SHIFT).isin(missing))
            runs.add(some.select(*hashes(F.col("url"))).distinct().repartition(runs.buckets, "h1", "h2"), missing, done)
        return runs, done

    def unseen(self, crawl_id: int, batch: DataFrame) -> DataFrame:
        """The pages of a batch (schema CRAWLED) whose URLs the crawl does not have, the first of each URL, as a written table."""
        urls, _ = self._urls(crawl_id)
        one = batch.select(F.struct(*batch.columns).alias("page"), "seq", *hashes(F.col("url"))).groupBy("h1", "h2").agg(F.min_by("page", "seq").alias("page"))
        with urls.settings():
            return Folder(self.spark, "unseen").save(urls.absent(one).select("page.*"), "pages")

    def add_pages(self, crawl_id: int, batch: DataFrame, saved: bool = False, new: bool = False) -> int:
        """Append crawled pages with their links (schema CRAWLED) as one batch; returns its number of pages.

        A URL that is there twice, in the batch or in the crawl, rejects the whole batch. saved: batch is
        a table that can be read again as it is. new: it is what unseen() has just given, so its URLs are
        not asked for once more.
        """
        crawl = self.get_crawl(crawl_id)
        work = Folder(self.spark, "batch")
        if not saved:
            batch = work.save(batch, "given")
        keys = batch.select(*hashes(F.col("url")))
        n, different = (batch.count(),) * 2 if new else keys.agg(F.count("*"), F.count_distinct("h1", "h2")).first()
        urls, done = self._urls(crawl_id)
        # a run that holds a hash is rare, so what it says is checked against the pages
        if different != n or not new and urls.any_of(keys, n) and not batch.join(self.pages(crawl_id), "url", "left_semi").isEmpty():
            raise ValueError("duplicate url")
        number = self._claim(crawl_id)
        with_id = work.numbered(batch, "pages", "seq", weight=F.size("links")).withColumn("id", F.lit(number << _SHIFT) + F.col("n"))
        self._write(with_id, crawl_id, "pages", PAGES, crawl["pages_version"])
        each = with_id.select("before", F.col("id").alias("from_page_id"), F.posexplode("links").alias("pos", "l")).withColumn("id", F.lit(number << _SHIFT) + F.col("before") + F.col("pos") + 1)
        self._write(each.select("id", "from_page_id", F.col("l.url").alias("to_url"), "l.text", "l.nofollow", "l.in_scope"), crawl_id, "links", LINKS, crawl["links_version"])
        self._count(batch.withColumn("batch", F.lit(number).cast("long")), crawl_id)
        urls.add(keys.repartition(urls.buckets, "h1", "h2"), [number], done)
        self._mark(number, n, crawl_id)
        return n

    # counters
    _COUNTS = "batch long, total long, status_2xx long, status_3xx long, status_4xx long, status_5xx long, errors long, blocked long, noindex long, via_nofollow long, max_depth int, duration_sum long, duration_n long, broken long, content_types map<string,long>, crawl_id long"
    #: The counter that has the total of a listing's filter.
    _OF_FILTER = {"": "total", **{f"{k}xx": f"status_{k}xx" for k in (2, 3, 4, 5)}, "error": "errors", "blocked": "blocked", "via_nofollow": "via_nofollow"}

    def _counters(self) -> DataFrame:
        if not self._exists("counters"):
            return self.spark.createDataFrame([], self._COUNTS)
        return self.spark.read.schema(self._COUNTS).parquet(f"{self.path}/counters").withColumn("broken", F.coalesce("broken", F.col("status_4xx") + F.col("status_5xx") + F.col("errors")))

    def _count(self, pages: DataFrame, crawl_id: int) -> None:
        """Write the counters of some pages, a row a batch (column batch), in one pass."""
        counts = [*P.counters(), F.count_if(X.is_broken()).alias("broken")]
        by_type = pages.groupBy("batch", "content_type").agg(*counts)
        names = [c for c in by_type.columns if c not in ("batch", "content_type", "max_depth")]
        types = F.map_from_entries(F.collect_list(F.when(F.col("content_type") != "", F.struct("content_type", "total"))))
        rows = by_type.groupBy("batch").agg(*(F.sum(c).alias(c) for c in names), F.max("max_depth").alias("max_depth"), types.alias("content_types"))
        rows.select(*(x.split()[0] for x in self._COUNTS.split(", ")[:-1])).coalesce(1).write.mode("append").parquet(f"{self.path}/counters/crawl_id={crawl_id}")

    def totals(self, crawl_id: int) -> dict[str, int]:
        """The number of pages of every filter of a listing, and of broken ones, from the counters."""
        names = [*dict.fromkeys(self._OF_FILTER.values()), "broken"]
        parts = self._counters().where(F.col("crawl_id") == crawl_id).join(self._done(), ["crawl_id", "batch"], "left_semi")
        row = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
        found = {f: row[c] for f, c in (self._OF_FILTER | {"broken": "broken"}).items()}
        found["via_nofollow"] -= self.get_crawl(crawl_id)["cleared"]
        return found

    def summary(self) -> DataFrame:
        """The counters of all crawls, a row each, from those of their batches; a crawl without pages has zeros."""
        parts = self._counters().join(self._done(), ["crawl_id", "batch"], "left_semi")
        sums = [c for c in parts.columns if c not in ("crawl_id", "batch", "max_depth", "content_types", "broken")]
        added = parts.groupBy("crawl_id").agg(*(F.sum(c).alias(c) for c in sums), F.max("max_depth").alias("max_depth"))
        out = self.crawls().select(F.col("id").alias("crawl_id"), "cleared").join(added, "crawl_id", "left").fillna(0)
        out = out.withColumn("via_nofollow", F.col("via_nofollow") - F.col("cleared")).withColumn("avg_duration_ms", X.int_avg(F.col("duration_sum"), F.col("duration_n")))
        return out.select("crawl_id", *(c for c in sums if not c.startswith("duration")), "max_depth", "avg_duration_ms")

    def content_types(self) -> DataFrame:
        parts = self._counters().join(self._done(), ["crawl_id", "batch"], "left_semi")
        return parts.select("crawl_id", F.explode("content_types").alias("content_type", "n")).groupBy("crawl_id", "content_type").agg(F.sum("n").alias("n"))

    def summarize(self, crawl_id: int) -> dict:
        self.get_crawl(crawl_id)
        row = self.summary().where(F.col("crawl_id") == crawl_id).drop("crawl_id").first().asDict()
        return row | {"content_types": {r.content_type: r.n for r in self.content_types().where(F.col("crawl_id") == crawl_id).collect()}}

    # versions
    def _switch(self, crawl_id: int, crawl: dict, tables: dict[str, tuple[DataFrame, object]], **values) -> None:
        """Write tables made of a crawl's present versions (those of `crawl`) under new ones, then let the control table name those.

        A stop before that changes nothing; Conflict if another process was first to replace the versions.
        """
        names = [f"{n}_version" for n in tables]
        # numbers of their own, so two processes never write to one folder
        new = {n: Exclusive(self.spark, f"{self.path}/numbers/{n}-{crawl_id}").next(crawl[f"{n}_version"]) for n in tables}
        for name, (rows, schema) in tables.items():
            self._write(rows, crawl_id, name, schema, new[name], "overwrite")

        def same(row) -> bool:
            if any(row[n] != crawl[n] for n in names):
                for name in tables:
                    self._fs.delete(self._version(crawl_id, name, new[name]), True)
                raise Conflict(f"crawl {crawl_id}: another change was first")
            return True

        self._update(crawl_id, same, **{f"{n}_version": F.lit(v) for n, v in new.items()}, **values)
        for name in tables:  # the version before stays for those who are reading it
            for x in self._fs.listStatus(self._version(crawl_id, name, new[name]).getParent()):
                at = x.getPath().getName()
                if at.startswith("version=") and int(at[8:]) < crawl[f"{name}_version"]:
                    self._fs.delete(x.getPath(), True)

    def _version(self, crawl_id: int, name: str, version: int):
        return self._path(f"{self.path}/{name}/crawl_id={crawl_id}/version={version}")

    def recompute_via_nofollow(self, crawl_id: int) -> int:
        """Clear marks of pages that a normal link reaches; returns how many. The crawl gets a new version of its pages."""
        crawl = self.get_crawl(crawl_id)
        before = self.pages(crawl_id)
        after = P.recompute_via_nofollow(before, self.links(crawl_id))
        n = before.where("via_nofollow").count() - after.where("via_nofollow").count()
        if n:
            self._switch(crawl_id, crawl, {"pages": (after, PAGES)}, cleared=F.lit(crawl["cleared"] + n))
        return n

    def compact(self, crawl_id: int, rows_per_file: int = 1_000_000) -> None:
        """Write a crawl's many small files anew as few, in order of id, without what broken batches left."""
        crawl = self.get_crawl(crawl_id)
        tables = {}
        for name, rows, schema in (("pages", self.pages(crawl_id), PAGES), ("links", self.links(crawl_id), LINKS)):
            tables[name] = (rows.repartitionByRange(max(1, -(-rows.count() // rows_per_file)), "id").sortWithinPartitions("id"), schema)
        self._switch(crawl_id, crawl, tables)

    # queries
    def list_pages(self, crawl_id: int, status: str = "", q: str = "", limit: int = 0, offset: int = 0) -> tuple[DataFrame, int]:
        """A page of the matches and how many there are; only a text filter makes them be counted, or sorted up to the page."""
        crawl = self.get_crawl(crawl_id)
        p, limit, offset = self.pages(crawl_id), P.clamp_limit(limit), max(0, offset)
        if q:
            return P.list_pages(p, crawl_id, status, q, limit, offset), P.matching(p, crawl_id, status, q).count()
        P.status_filter(status)
        total = self.totals(crawl_id)[status]
        if status == "via_nofollow" and crawl["cleared"]:  # the batches' counts are of before
            return P.list_pages(p, crawl_id, status, q, limit, offset), total
        near, offset = self._range(crawl_id, status, offset, limit)
        some = P.matching(p.where(near), crawl_id, status)
        if offset > _SORTED:
            some, offset = some.where(F.col("id") >= nth(some.select(F.col("id").alias("seq")), offset + 1)), 0
        return some.orderBy("id").offset(offset).limit(limit), total

    def _range(self, crawl_id: int, status: str, offset: int, limit: int, first: int = 0):
        """A condition on ids that holds for the limit matches after an offset, and the offset within it: whole batches, found by the sums of their counts."""
        counter = self._OF_FILTER[status]
        parts = self._counters().where((F.col("crawl_id") == crawl_id) & (F.col("batch") >= first)).join(self._done(), ["crawl_id", "batch"], "left_semi")
        lo, hi, before, rest = None, first, 0, offset
        for batch, n in parts.where(F.col(counter) > 0).orderBy("batch").select("batch", counter).collect():  # a row a batch
            if lo is None and before + n > offset:
                lo, rest = batch, offset - before
            before, hi = before + n, batch
            if before >= offset + limit:
                break
        return (F.col("id").between(lo << _SHIFT, ((hi + 1) << _SHIFT) - 1) if lo is not None else F.lit(False)), rest

    def pages_after(self, crawl_id: int, status: str = "", after: int = 0, limit: int = 0) -> DataFrame:
        """The next matches in order of id after a page's id; reads the batches that hold them only."""
        self.get_crawl(crawl_id)
        limit, own = P.clamp_limit(limit), after >> _SHIFT
        counter = self._OF_FILTER[status]
        # as many more as the batch of that id holds, all of which may lie before it
        skipped = self._counters().where((F.col("crawl_id") == crawl_id) & (F.col("batch") == own)).agg(F.coalesce(F.sum(counter), F.lit(0))).first()[0]
        cleared = status == "via_nofollow" and self.get_crawl(crawl_id)["cleared"]
        near = F.lit(True) if cleared else self._range(crawl_id, status, 0, skipped + limit, own)[0]
        return P.matching(self.pages(crawl_id).where(near & (F.col("id") > after)), crawl_id, status).orderBy("id").limit(limit)

    def all_pages(self, crawl_id: int, status: str = "", size: int = P.MAX_LIMIT):
        """All matches in order of id, a page of them at a time, each from where the last one ended."""
        after = 0
        while rows := self.pages_after(crawl_id, status, after, size).collect():
            yield from rows
            after = rows[-1].id

    def get_page(self, crawl_id: int, page_id: int) -> dict:
        """A page with its first links out and in, and how many there are."""
        row = P.find_page(self.pages(crawl_id), crawl_id, id=page_id).first()
        if row is None:
            raise NotFound(f"page {page_id}")
        pages, links = self.pages(crawl_id), self.links(crawl_id)
        return {
            "page": row.asDict(),
            "outlinks": [r.asDict() for r in P.page_outlinks(links, crawl_id, page_id).collect()],
            "inlinks": [r.asDict() for r in P.page_inlinks(pages, links, crawl_id, row.url).collect()],
            "outlinks_total": links.where(F.col("from_page_id") == page_id).count(),
            "inlinks_total": links.where(F.col("to_url") == row.url).count(),
        }

    def find_page(self, crawl_id: int, url: str) -> dict:
        row = P.find_page(self.pages(crawl_id), crawl_id, url=url).first()
        if row is None:
            raise NotFound(url)
        return row.asDict()

    def broken(self, crawl_id: int, limit: int = 0, offset: int = 0) -> DataFrame:
        self.get_crawl(crawl_id)
        return P.broken_page(self.pages(crawl_id), self.links(crawl_id), crawl_id, limit, offset)

    def referrers(self, crawl_id: int, urls: list[str], per_url: int = 3) -> DataFrame:
        wanted = self.spark.createDataFrame([(crawl_id, u) for u in urls], "crawl_id long, to_url string")
        return P.referrers(self.pages(crawl_id), self.links(crawl_id), wanted, per_url).orderBy("to_url", "rn")

    def scan(self, crawl_id: int, *columns: str) -> DataFrame:
        """Columns of all pages with n = 1, 2, ... in order of id, as a written table: a scan that stays on the executors."""
        self.get_crawl(crawl_id)
        work = Folder(self.spark, "scan")
        return work.numbered(self.pages(crawl_id).select("id", *(c for c in columns if c != "id")), "pages", "id").drop("before")

    def for_each_page(self, crawl_id: int, f) -> None:
        """f(row) for every page in order of id, streamed to the driver partition by partition; scan() is for work that can be shared out."""
        self.get_crawl(crawl_id)
        for row in self.pages(crawl_id).orderBy("id").toLocalIterator(prefetchPartitions=True):
            f(row)

    def report(self, crawl_id: int, seed: int = 0, now: datetime | None = None) -> dict:
        return report_plan.build(self.get_crawl(crawl_id), self.pages(crawl_id), self.links(crawl_id), seed, now)


def crawl_into(store: Store, config, fetcher, progress=None, stopped=None, crawl_id: int | None = None, **flush) -> int:
    """Crawl and store: the crawl's id, with its pages, robots.txt, corrected marks and final status.

    Pages are stored as a batch when a round of them is there, or a slice of it (flush_pages,
    flush_seconds), so a running crawl can be read and a stop loses a slice at most. progress(pages)
    gets each stored batch. stopped() true ends the crawl as cancelled.
    """
    if crawl_id is None:
        crawl_id = store.create_crawl(config.seed, config.to_json())

    def sink(pages: DataFrame) -> None:
        store.add_pages(crawl_id, pages, saved=True)
        if progress:
            progress(pages)

    engine = None
    status, error, raised = "done", "", None
    try:
        engine = Engine(store.spark, config, fetcher, sink, stopped, **flush)
        engine.run()
    except Cancelled:
        status = "cancelled"
    except Exception as e:  # noqa: BLE001  the crawl is finished first
        status, error, raised = "failed", str(e), e
    if config.follow_nofollow and not raised:
        store.recompute_via_nofollow(crawl_id)
    store.set_robots(crawl_id, engine.stats.robots_txt if engine else "")
    store.finish_crawl(crawl_id, status, error)
    if raised:
        raise raised
    return crawl_id


def progress_lines(out):
    """A progress callback that writes a numbered line a page to a file-like object."""
    number = 0

    def write(pages: DataFrame) -> None:
        nonlocal number
        for r in pages.select("status", "blocked", "content_type", "url", "error").orderBy("seq").toLocalIterator():
            number += 1
            code = str(r.status) if r.status > 0 else "BLOQ" if r.blocked else "ERR"
            out.write(f"[{number:4d}] {code:<4} {r.content_type:<11} {r.url}" + (f" ({r.error})" if r.blocked and r.error else "") + "\n")

    return write


def json_line(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, default=str)

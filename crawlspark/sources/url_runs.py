"""Which URLs a crawl has: levelled, sorted runs of URL hashes.

A run is a Parquet table of 128-bit hashes (h1, h2), bucketed and sorted by them. New URLs come as
a run of level 0; when a level holds `fan` runs they are merged into one of the next, so
a URL is rewritten as often as there are levels. A manifest names the runs that hold; its next
version is created only if nobody else has, so two writers cannot both win.

Lookups move the URLs asked for and never the runs: a large set is joined bucket beside bucket,
a small one is pushed down to the files, whose footers have the bounds of their sorted hashes and
Bloom filters. A false match needs two URLs with equal 128-bit hashes.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("h1", "h2")
#: Up to so many URLs are pushed down as a list.
FEW = 2000
_PLANNING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def hashes(url: Column) -> list[Column]:
    return [F.xxhash64(url).alias("h1"), F.xxhash64(F.lit("second"), url).alias("h2")]


class Conflict(RuntimeError):
    """Another writer changed the runs first."""


class UrlRuns:
    def __init__(self, spark: SparkSession, path: str, fan: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self._jvm = spark.sparkContext._jvm
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._tables: dict[str, str] = {}
        self._set(self._read_manifest())
        if not self.runs:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # the manifest
    def _versions(self) -> list[int]:
        at = self._Path(f"{self.path}/manifest")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _read_manifest(self) -> dict:
        for v in reversed(self._versions()):
            text = self.spark.read.text(f"{self.path}/manifest/{v}", wholetext=True).first()
            if text and text[0]:
                return json.loads(text[0]) | {"version": v}
        return {"version": 0, "runs": [], "buckets": None}

    def _set(self, manifest: dict) -> None:
        self.version, self.runs, self.buckets = manifest["version"], manifest["runs"], manifest["buckets"]

    def _commit(self, runs: list[dict]) -> None:
        """Make these the runs that hold; Conflict if someone else has made a version since this one was read."""
        v = self.version + 1
        made = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        out = self._fs.create(self._Path(made))
        out.write(bytearray(json.dumps({"runs": runs, "buckets": self.buckets}).encode()))
        out.close()
        if v in self._versions() or not self._fs.rename(self._Path(made), self._Path(f"{self.path}/manifest/{v}")):
            self._fs.delete(self._Path(made), False)
            raise Conflict(self.path)
        for old in self._versions()[:-2]:
            self._fs.delete(self._Path(f"{self.path}/manifest/{old}"), False)
        self.version, self.runs = v, runs

    def stale(self) -> bool:
        """Whether another writer has made a version since this one was read."""
        return (self._versions() or [0])[-1] != self.version

    # runs
    def _table(self, run: dict) -> DataFrame:
        """A run as a table of the session's catalogue, which is what knows of buckets."""
        name = self._tables.get(run["name"])
        if name is None:
            name = self._tables[run["name"]] = f"url_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['name']}'")
        return self.spark.table(name)

    def tags(self) -> set[int]:
        """What the runs have been made of, as add() was told."""
        return {t for r in self.runs for t in r["tags"]}

    def drop(self, tags: set[int]) -> None:
        """Take out the runs of these tags, which were never merged."""
        gone = [r for r in self.runs if tags & set(r["tags"])]
        if gone:
            self._commit([r for r in self.runs if r not in gone])
            self._delete(gone)

    def _delete(self, runs: list[dict]) -> None:
        for r in runs:
            self._forget(r["name"])
            self._fs.delete(self._Path(f"{self.path}/{r['name']}"), True)

    def _write(self, keys: DataFrame, level: int, tags: list[int]) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        made = f"url_made_{uuid.uuid4().hex}"
        writer = keys.select(*KEY).write.format("parquet").option("path", f"{self.path}/{name}").option("parquet.bloom.filter.enabled#h1", "true")
        writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(made)
        self._tables[name] = made
        return {"name": name, "level": level, "buckets": self.buckets, "tags": tags}

    @contextmanager
    def settings(self, few: bool = False):
        """For plans over runs, which must be made inside: a run is sorted, as a bucket is one file; lists of up to FEW values are pushed down."""
        wanted = _PLANNING | ({"spark.sql.parquet.pushdown.inFilterThreshold": str(FEW)} if few else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def absent(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) that no run has. To be planned under settings(); keys are dealt by (h1, h2), the runs stay where they are."""
        for run in self.runs:
            keys = keys.join(self._table(run).hint("merge"), list(KEY), "left_anti")
        return keys

    def any_of(self, keys: DataFrame, n: int) -> list[str]:
        """The names of runs that have some of n keys (h1, h2). Of few keys, only row groups that may hold them are read."""
        if not self.runs or not n:
            return []
        if n > FEW:
            with self.settings():
                return [run["name"] for run in self.runs if not keys.join(self._table(run).hint("merge"), list(KEY), "left_semi").isEmpty()]
        pairs = {(r[0], r[1]) for r in keys.select(*KEY).collect()}
        with self.settings(few=True):
            return [run["name"] for run in self.runs if pairs & {(r[0], r[1]) for r in self.lookup(run, [h for h, _ in pairs]).collect()}]

    def lookup(self, run: dict, first: list[int]) -> DataFrame:
        """Rows of a run whose h1 is in a list."""
        return self.spark.read.schema("h1 long, h2 long").parquet(f"{self.path}/{run['name']}").where(F.col("h1").isin(first))

    def add(self, keys: DataFrame, tags: list[int] = (), settled: set[int] | None = None) -> None:
        """Add keys (h1, h2) that no run has, each once. tags say what they are of; only runs whose tags are all settled are merged (None: all are)."""
        fixed = lambda r: settled is None or settled >= set(r["tags"])
        runs, gone, level = [*self.runs, self._write(keys, 0, sorted(tags))], [], 0
        while len(own := [r for r in runs if r["level"] == level and fixed(r)]) >= self.fan:
            with self.settings():
                merged = self._table(own[0])
                for r in own[1:]:
                    merged = merged.unionByName(self._table(r))
                merged = self._write(merged.repartition(self.buckets, *KEY), level + 1, sorted(t for r in own for t in r["tags"]))
            runs, gone, level = [r for r in runs if r not in own] + [merged], gone + own, level + 1
        self._commit(runs)
        self._delete(gone)

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def close(self) -> None:
        """Take the runs from the session's catalogue; their files stay."""
        for name in list(self._tables):
            self._forget(name)

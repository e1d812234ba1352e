"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line keys (128-bit hashes), bucketed and sorted by key, with the number of
documents and the largest document of each. Documents come in batches. A batch's keys
are merge-anti-joined with the runs: unseen keys become the batch's own run, keys that a
run holds are an update of their counts. When a level holds `fan` runs, they and the
updates are compacted into one run of the next level, so a key is rewritten as often as
there are levels.

Scale: lines are reduced to (document, position, hash) before any shuffle, counts
are pre-aggregated, and texts are shuffled once, to meet the positions they lose. All runs
have the same buckets, a sorted file each, so an anti-join reads bucket beside bucket and
shuffles and sorts no run; compactions alone deal keys anew. A batch's lines are a folder of their own, so
each is read once. A key that a third of all documents hold has one row in its run; the
join with the lines is split by adaptive execution.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Workspace, load, lower_ascii, shuffle_parts

KEY = ["h1", "h2"]
_PLANNING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row_hash, pos, h1, h2 of the lines whose key has min_chars code points at least."""
    keys = F.transform(F.split(lower_ascii(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(keys).alias("pos", "key"))
    return lines.where(F.char_length("key") >= min_chars).select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The runs: add() takes a batch of (doc_id, h1, h2), counts() gives h1, h2, n_docs, max_doc over all batches, to be run under settings().

    Batches must not share documents. Rows may repeat.
    """

    def __init__(self, spark: SparkSession, work: Workspace, fan: int = 3):
        self.spark, self.work, self.fan, self.added = spark, work, fan, 0
        self.buckets = shuffle_parts(spark)
        self.tables: list[str] = []
        self.levels: list[list[DataFrame]] = [[]]
        self.updates: list[DataFrame] = []

    def _run(self, df: DataFrame) -> DataFrame:
        """Write df, partitioned by key as an aggregate or a join with runs leaves it, so that a bucket is one sorted file."""
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.work.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    @contextmanager
    def settings(self):
        """For plans over runs: a run is sorted, as a bucket is one file; a union of runs is not taken for bucketed (it is dealt by run, not by bucket)."""
        before = {k: self.spark.conf.get(k, None) for k in _PLANNING}
        for k, v in _PLANNING.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    @staticmethod
    def _merged(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")) if len(parts) > 1 else out

    def _runs(self) -> list[DataFrame]:
        return [x for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch; returns the keys that no run held before."""
        self.added += 1
        with self.settings():
            counted = self._run(batch.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")))
            fresh = counted
            if runs := self._runs():
                for x in runs:
                    fresh = fresh.join(x.select(*KEY).hint("merge"), KEY, "left_anti")
                fresh = self._run(fresh)
                self.updates.append(self._run(counted.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti")))
            self.levels[0].append(fresh)
            level = 0
            while len(self.levels[level]) >= self.fan:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                # updates of keys in other runs stay in this run and are summed by a later merge
                run = self._run(self._merged(self.levels[level] + self.updates))
                self.levels[level], self.updates = [], []
                self.levels[level + 1].append(run)
                level += 1
        return fresh

    def counts(self) -> DataFrame:
        return self._merged(self._runs() + self.updates)

    def close(self) -> None:
        """Take the runs from the catalogue and delete their files."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.drop(*self.tables)
        self.tables = []


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan: int = 3) -> DataFrame:
    """The rows of docs (doc_id, text) with n_lines, n_dropped and kept_text.

    Lines are split at \\n; null text is one empty line. The key of a line is the line
    without ASCII white space at both ends, A-Z lower-cased. Keys of min_chars code
    points at least in min_docs documents or more lose their lines except in the
    document with the largest id. Repeated rows of one id count as one document and
    are treated alike; a null id is a document that every other id outranks, and its
    lines are counted, too. Other columns of docs are dropped. An empty table gives no rows;
    a text of any length is split whole.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    hashed.write.option("compression", "zstd").partitionBy("batch").parquet(f"{work.path}/lines")
    lines = spark.read.schema(hashed.schema).parquet(f"{work.path}/lines")
    runs = LineRuns(spark, work, fan)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    with runs.settings():
        frequent = work.save(runs.counts().where(F.col("n_docs") >= min_docs).select(*KEY, "max_doc"), "frequent")
    runs.close()
    dropped = (
        lines.join(frequent, KEY)
        .where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        .groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"))
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    out = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("r")), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("drop"), F.lit(0)).cast("long"))
    # the stretches between dropped positions: linear in the lines, however many are dropped
    between = F.expr(
        "flatten(transform(sequence(0, size(drop)), i -> slice(lines, if(i = 0, 0, drop[i - 1] + 1) + 1,"
        " if(i = size(drop), size(lines), get(drop, i)) - if(i = 0, 0, drop[i - 1] + 1))))"
    )
    return out.select("doc_id", "text", "n_lines", "n_dropped", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(between, "\n")).alias("kept_text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.max_doc AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Centroid clustering with integer components: Lloyd's rounds by differences.

Vectors are packed into blocks once and stay in their buckets. What a round persists is each
vector's owner and distance and the sums of every cluster. A round takes the
distances to the centroids that changed and, for vectors whose own centroid moved away from
them, to the others; vectors that change hands give their components, with signs, to
the sums. Centroids come from the sums, so a round in which little moves costs little.

Scale: blocks and assignments share buckets, so a round joins them without a shuffle; a
block sends at most a row a cluster. The driver holds k centroids. Every round is a table
in the shared folder, and only the last one is kept.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, load

#: Components beyond this may give distances beyond a long.
_MOST = 2**27
_TRANSFER = "array<struct<cluster:int,n:long,sums:array<long>>>"
_STATE = f"block long, owner binary, dist binary, moved {_TRANSFER}, inertia array<long>"


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the floors of scale times the components, of the vectors with exactly dims components, all finite."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(f"e is not null and size(e) = {dims} and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return kept.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _packed(rows: int, dims: int, dtype: str):
    """Blocks of at most `rows` vectors; ids stay a list, as they may be null."""

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([pa.array([base + number]), ids, pa.array([v.tobytes()], pa.binary())], names=["block", "ids", "vecs"])
                number += 1

    return run


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows of v to those of c, exact, as int64."""
    most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if 4 * v.shape[1] * int(most) ** 2 < 2**53:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return ((v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


def reassign(v: np.ndarray, c: np.ndarray, changed: np.ndarray, owner: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and distance, from those to the centroids before some changed."""
    k, n, far = len(c), len(v), np.iinfo(np.int64).max
    d = np.full((n, k), far)
    d[:, changed] = distances(v, c[changed])
    rows = np.arange(n)
    own_moved = changed[owner]
    d[rows[~own_moved], owner[~own_moved]] = dist[~own_moved]
    # whoever's centroid came no farther is still nearer to it than to all that stayed in place
    left = np.flatnonzero(own_moved & (d[rows, owner] > dist))
    if len(left) and not changed.all():
        d[np.ix_(left, np.flatnonzero(~changed))] = distances(v[left], c[~changed])
    best = d.argmin(axis=1)
    return best, d[rows, best]


def _round(c: np.ndarray, changed: np.ndarray | None, dims: int, dtype: str):
    """A block's new owners and distances, what its vectors give to the sums, and its inertia a cluster; changed is None for the first round."""
    k = len(c)

    def run(batches):
        for batch in batches:
            for block, vecs, owner, dist in zip(*(x.to_pylist() for x in batch.columns)):
                v = np.frombuffer(vecs, dtype).astype(np.int64).reshape(-1, dims)
                if changed is None:
                    d = distances(v, c)
                    new = d.argmin(axis=1)
                    far, old = d[np.arange(len(v)), new], None
                    gone = np.arange(len(v))
                else:
                    old = np.frombuffer(owner, np.int16).astype(np.int64)
                    new, far = reassign(v, c, changed, old, np.frombuffer(dist, np.int64))
                    gone = np.flatnonzero(new != old)
                n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
                np.add.at(n, new[gone], 1)
                np.add.at(sums, new[gone], v[gone])
                if old is not None:
                    np.subtract.at(n, old[gone], 1)
                    np.subtract.at(sums, old[gone], v[gone])
                inertia = np.zeros(k, np.int64)
                np.add.at(inertia, new, far)
                moved = [{"cluster": int(j), "n": int(n[j]), "sums": sums[j].tolist()} for j in range(k) if n[j] or sums[j].any()]
                moved_type = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
                out = (pa.array([block]), pa.array([new.astype(np.int16).tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary()), pa.array([moved], moved_type), pa.array([inertia.tolist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(list(out), names=["block", "owner", "dist", "moved", "inertia"])

    return run


def _unpacked():
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten()
                owner, dist = np.frombuffer(batch.column(1)[i].as_py(), np.int16), np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


class _Buckets:
    """Tables of blocks in the shared folder, bucketed and sorted by block."""

    def __init__(self, spark: SparkSession, work: Workspace, n: int):
        self.spark, self.work, self.n, self.names = spark, work, n, []

    def save(self, df: DataFrame) -> DataFrame:
        name = f"blocks_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.format("parquet").option("path", f"{self.work.path}/{name}").option("compression", "zstd").bucketBy(self.n, "block").sortBy("block").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.names.remove(name)
        self.work.delete(*names)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", block_rows: int = 2048, bucket_blocks: int = 16) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) a vector, and the final centroids.

    vectors has vec_id and embedding; a vector takes part if it has exactly dims components,
    none null, NaN or infinite, as integers floor(scale x). The first centroids are the k
    vectors with the least sha256 of seed and vec_id; of rows that share it the one with
    the least components; rows without vec_id come last. With fewer vectors than k there are as many
    clusters. Ties go to the smaller number; a centroid that owns nothing stays. Repeated
    rows are vectors each. Other columns are not read; an empty table gives no rows. Components
    beyond 2^27 raise an error: their distances need not fit a long.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "clustering")
    clean = whole_vectors(vectors, dims, scale)
    total, most = clean.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if total and most > _MOST:
        raise ValueError(f"components beyond {_MOST}")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
    if not total:
        return spark.createDataFrame([], schema), []
    first = clean.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    k = len(c)
    dtype = "<i2" if most < 2**15 else "<i4"
    buckets = _Buckets(spark, work, max(1, min(math.ceil(total / (block_rows * bucket_blocks)), 100_000)))
    packed = clean.mapInArrow(_packed(block_rows, dims, dtype), "block long, ids array<long>, vecs binary")
    try:
        blocks = buckets.save(packed.repartition(buckets.n, "block"))
        sums, state, changed = None, None, None
        for r in range(rounds + 1):
            given = blocks.select("block", "vecs")
            both = given.join(state.select("block", "owner", "dist").hint("merge"), "block") if state is not None else given.select("*", F.lit(None).cast("binary").alias("owner"), F.lit(None).cast("binary").alias("dist"))
            new = buckets.save(both.mapInArrow(_round(c, changed, dims, dtype), _STATE))
            if state is not None:
                buckets.drop(buckets.names[-2])
            state = new
            if r == rounds:
                break
            given_to = state.select(F.inline("moved")).select("cluster", "n", F.posexplode("sums").alias("at", "x"))
            if sums is not None:
                given_to = given_to.unionByName(sums)
            sums = work.save(given_to.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), f"sums{r}")
            before = c.copy()
            for j, at, n, x in sums.collect():  # a row a cluster and component
                if n:
                    c[j, at] = x // n
            changed = (c != before).any(axis=1)
            if not changed.any():
                break
        ids = blocks.select("block", "ids").join(state.select("block", "owner", "dist").hint("merge"), "block").select("ids", "owner", "dist")
        owned = work.save(ids.mapInArrow(_unpacked(), "vec_id long, cluster int, distance long"), "owned")
        inertia = [0] * k
        for j, x in state.select(F.posexplode("inertia").alias("cluster", "x")).groupBy("cluster").agg(F.sum("x")).collect():
            inertia[j] = x
    finally:
        buckets.drop(*buckets.names)
    of = F.element_at(F.array(*(F.lit(x).cast("long") for x in inertia)), F.col("cluster") + 1)
    return owned.select("vec_id", "cluster", "distance", of.alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia")), c.tolist()


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    owned, centroids = cluster(load(spark, sf_dir, "embeddings"))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    return owned.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, sha)), F.col("cluster") + 1))


def _round_sql(r: int) -> str:
    return f"""
d{r} AS (SELECT v.r, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT r, CAST(k AS INTEGER) AS k, CAST(d AS BIGINT) AS d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS best FROM d{r}) WHERE best = 1)"""


def _update_sql(r: int) -> str:
    # floor, for sums of either sign
    return f"""
s{r} AS (SELECT k, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS pos FROM a{r} a JOIN v ON a.r = v.r) GROUP BY k, pos),
m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v) ORDER BY h NULLS LAST, v LIMIT 8),
{",".join(_round_sql(r) + "," + _update_sql(r) for r in range(10))},{_round_sql(10)},
i AS (SELECT k, CAST(sum(d) AS BIGINT) AS i FROM a10 GROUP BY k)
SELECT v.vec_id, a.k AS cluster, a.d AS distance, i.i AS cluster_inertia, CAST((SELECT sum(d) FROM a10) AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 a JOIN v ON a.r = v.r JOIN c10 c ON c.k = a.k JOIN i ON i.k = a.k
"""

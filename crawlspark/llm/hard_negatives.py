"""Hard-negative mining by bit-sliced integer products.

Vectors are stored as bit-planes of their integer components, packed, in blocks. A product with an
anchor grows plane by plane, the most significant first; what the planes left can still
add lies between minus the anchor's negative and its positive mass, times 2^j - 1. So every
pair has an interval that narrows, and a candidate is dropped for an anchor once its interval
lies outside what the anchor asks for, or below k candidates that surely qualify, and for good once no
anchor of the chunk needs it; planes further down are opened for the others only.

An anchor asks with windows [lo, hi] of scores: the k best inside are wanted. Blocks are taken in
rounds, 1 of 64, 7 of 64, then the rest, and the k-th score that a round finds is the lo of
the next, so later rounds send few rows.

Scale: a task gets a block and the anchors of all chunks, chunk by chunk; a chunk goes once to
each block that it may ask. Positives are asked from the blocks that hold the anchor's label only.
No label is a group of its own: blocks are cut by rows, so a label of a third of the rows is in a third of the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, load

_BLOCK = "part int, number int, n int, bits int, has array<long>, ids binary, rows binary, labels binary, planes binary"
_CHUNK = "chunk long, has array<long>, rows binary, labels binary, vecs binary, lo binary, hi binary"
_FOUND = "row long, w int, vec_id long, c_row long, score long"
#: Lower and upper ends of windows that ask nothing.
_HIGH, _LOW = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def slice_bits(v: np.ndarray) -> tuple[int, bytes]:
    """Number of planes and planes of integer rows in two's complement, the most significant (the sign) first, eight components a byte."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    bits = max((~low).bit_length() if low < 0 else 0, high.bit_length()) + 1
    return bits, b"".join(np.packbits((v >> j) & 1, axis=1).tobytes() for j in range(bits - 1, -1, -1))


def plane(planes: bytes, i: int, n: int, dims: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The i-th plane from above, as zeros and ones; only some rows of it, if given."""
    width = (dims + 7) // 8
    packed = np.frombuffer(planes, np.uint8, n * width, i * n * width).reshape(n, width)
    return np.unpackbits(packed if rows is None else packed[rows], axis=1, count=dims)


def _kth(lower: np.ndarray, sure: np.ndarray, k: int, none) -> np.ndarray:
    """The k-th largest of each row of lower where sure, none where there are fewer."""
    if lower.shape[1] < k:
        return np.full(len(lower), none, lower.dtype)
    kept = np.where(sure, lower, none)
    return np.partition(kept, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]


def qualify(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, may: np.ndarray, bits: int, planes: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Anchor, candidate and score of all pairs that may be among the k best of a window; and how many pairs were left after each plane.

    a: anchors; lo, hi: windows, a row an anchor; may: pairs (anchor, candidate) that count at all.
    """
    n, dims = may.shape[1], a.shape[1]
    mass = np.abs(a).sum(axis=1).max(initial=0)
    if int(mass) << bits >= 2**62:
        raise ValueError("scores do not fit a long")
    # floats hold all sums exactly and multiply faster; wider sums stay integers
    kind = np.float64 if int(mass) << bits < 2**52 else np.int64
    plus, minus = np.where(a > 0, a, 0).sum(axis=1), np.where(a < 0, -a, 0).sum(axis=1)
    who, cand, left = np.arange(len(a)), np.arange(n), []
    total, q = np.zeros(may.shape, kind), a.astype(kind)
    sparse = None  # pairs, once few are left
    for i in range(bits):
        j = bits - 1 - i
        weight = -(1 << j) if i == 0 else 1 << j
        if sparse is None:
            total += (q[who] @ plane(planes, i, n, dims, cand).astype(kind).T) * weight
            span = (1 << j) - 1
            low = total - (minus[who] * span).astype(kind)[:, None]
            up = total + (plus[who] * span).astype(kind)[:, None]
            alive = np.zeros(may.shape, bool)
            for w in range(lo.shape[1]):
                wl, wh = lo[who, w][:, None], hi[who, w][:, None]
                inside = may & (up >= wl) & (low <= wh)
                if i and inside.any():
                    t = _kth(low, inside & (low >= wl) & (up <= wh), k, kind(-(2.0**60)) if kind is np.float64 else _LOW)
                    inside &= up >= t[:, None]
                alive |= inside
            may = alive
            keep_who, keep = may.any(axis=1), may.any(axis=0)
            if not (keep_who.all() and keep.all()):
                who, cand, may, total = who[keep_who], cand[keep], may[np.ix_(keep_who, keep)], total[np.ix_(keep_who, keep)]
            left.append(int(may.sum()))
            if 16 * left[-1] < may.size or i == bits - 1:
                at, of = np.nonzero(may)
                sparse = [who[at], cand[of], total[at, of].astype(np.int64)]
        else:
            ai, ci, s = sparse
            for at in range(0, len(ai), 1 << 16):
                part = slice(at, at + (1 << 16))
                s[part] += np.einsum("ij,ij->i", a[ai[part]], plane(planes, i, n, dims, ci[part]).astype(np.int64)) * weight
            span = (1 << j) - 1
            low, up = s - minus[ai] * span, s + plus[ai] * span
            ok = ((up[:, None] >= lo[ai]) & (low[:, None] <= hi[ai])).any(axis=1)
            sparse = [x[ok] for x in sparse]
            left.append(int(ok.sum()))
    return *(sparse or [np.zeros(0, np.int64)] * 3), left


def _best(ai: np.ndarray, ci: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For each window the first k pairs inside it: window number, pair number."""
    for w in range(lo.shape[1]):
        inside = np.flatnonzero((s >= lo[ai, w]) & (s <= hi[ai, w]))
        order = inside[np.lexsort((rows[ci[inside]], ids[ci[inside]], -s[inside], ai[inside]))]
        starts = np.flatnonzero(np.diff(ai[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        yield w, order[rank < k]


def _ask(dims: int, k: int, same: bool):
    """What a block holds for each chunk."""

    def run(batches):
        for batch in batches:
            for a_rows, a_labels, vecs, lo, hi, n, bits, ids, rows, labels, planes in zip(*(c.to_pylist() for c in batch.columns)):
                a_rows, a_labels, ids, rows, labels = (np.frombuffer(x, np.int64) for x in (a_rows, a_labels, ids, rows, labels))
                a = np.frombuffer(vecs, np.int64).reshape(-1, dims)
                lo, hi = (np.frombuffer(x, np.int64).reshape(len(a), -1) for x in (lo, hi))
                may = (a_labels[:, None] == labels) == same
                if same:
                    may &= a_rows[:, None] != rows
                if not may.any():
                    continue
                ai, ci, s, _ = qualify(a, lo, hi, may, bits, planes, k)
                for w, of in _best(ai, ci, s, lo, hi, ids, rows, k):
                    if len(of):
                        out = (a_rows[ai[of]], np.full(len(of), w, np.int32), ids[ci[of]], rows[ci[of]], s[of])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["row", "w", "vec_id", "c_row", "score"])

    return run


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    """A row a list; shorter lists are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _distinct(column: pa.Array) -> pa.Array:
    """The different values, as one list."""
    return pa.array([np.unique(column.to_numpy()).tolist()], pa.list_(pa.int64()))


def _blocks(dims: int, rows: int):
    """Blocks of at most `rows` vectors, in the order of the partition."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                x = batch.slice(at, rows)
                bits, planes = slice_bits(_flat(x.column(3), dims))
                flat = [_distinct(x.column(2)), *(pa.array([x.column(i).to_numpy().tobytes()], pa.binary()) for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([x.num_rows], pa.int32()), pa.array([bits], pa.int32()), *flat, pa.array([planes], pa.binary())], names=["part", "number", "n", "bits", "has", "ids", "rows", "labels", "planes"])
                number += 1

    return run


def _chunks(dims: int, rows: int):
    """Chunks of at most `rows` anchors (row, label, v, lo, hi), in the order of the partition."""

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                x = batch.slice(at, rows)
                lists = [c.flatten().to_numpy(zero_copy_only=False) for c in (x.column(3), x.column(4))]
                flat = (x.column(0).to_numpy(), x.column(1).to_numpy(), _flat(x.column(2), dims), *lists)
                yield pa.RecordBatch.from_arrays([pa.array([base + number]), _distinct(x.column(1)), *(pa.array([np.ascontiguousarray(f, np.int64).tobytes()], pa.binary()) for f in flat)], names=["chunk", "has", "rows", "labels", "vecs", "lo", "hi"])
                number += 1

    return run


class _Index:
    """The blocks of all vectors, in the order of label, numbered without gaps."""

    def __init__(self, work: Workspace, clean: DataFrame, total: int, dims: int, block_rows: int, chunk_rows: int):
        self.work, self.dims, self.chunk_rows = work, dims, chunk_rows
        parts = max(1, min(math.ceil(total / (4 * block_rows)), 100_000))
        ordered = clean.select("vec_id", "row", "label", "v").repartitionByRange(parts, "label", F.xxhash64("row")).sortWithinPartitions("label", F.xxhash64("row"))
        blocks = work.save(ordered.mapInArrow(_blocks(dims, block_rows), _BLOCK), "numbered")
        # a row a partition, of which there are 100,000 at most
        counts = dict(blocks.groupBy("part").count().collect())
        starts, self.n = {}, 0
        for p in sorted(counts):
            starts[p], self.n = self.n, self.n + counts[p]
        first = work.spark.createDataFrame([(p, s) for p, s in starts.items()] or [(-1, 0)], "part int, first int")
        self.blocks = blocks.join(F.broadcast(first), "part").withColumn("no", (F.col("first") + F.col("number")).cast("long")).drop("part", "number", "first")
        self.parts = max(1, min(self.n, 100_000))

    def rounds(self):
        """Numbers of blocks in disjoint rounds that together are all, as conditions on no."""
        steps = [s for s in (64, 8) if s < self.n] + [1]
        for i, s in enumerate(steps):
            yield (f"no % {s} = 0" if s > 1 else "true") + (f" and no % {steps[i - 1]} <> 0" if i else "")

    def search(self, anchors: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """row, w, vec_id, c_row, score, rank of the k best in every window of the anchors (row, label, v, lo, hi), of their own or of other labels."""
        best, last = None, []
        parts = max(1, min(math.ceil(anchors.count() / self.chunk_rows), 100_000))
        for i, which in enumerate(self.rounds()):
            held = anchors if best is None else self._raised(anchors, best, k)
            ordered = held.select("row", "label", "v", "lo", "hi").repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row")
            chunks = self.work.save(ordered.mapInArrow(_chunks(self.dims, self.chunk_rows), _CHUNK), f"{name}-chunks{i}")
            if same:  # the blocks that hold the labels of a chunk follow each other
                spans = self.blocks.select(F.explode("has").alias("label"), "no").groupBy("label").agg(F.min("no").alias("a"), F.max("no").alias("b"))
                ends = chunks.select("chunk", F.explode("has").alias("label")).join(spans, "label").groupBy("chunk").agg(F.min("a").alias("a"), F.max("b").alias("b"))
                chunks = chunks.join(ends, "chunk")
            else:
                chunks = chunks.withColumn("a", F.lit(0)).withColumn("b", F.lit(self.n - 1))
            sent = chunks.withColumn("no", F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long")))).where(which).select("no", "rows", "labels", "vecs", "lo", "hi")
            blocks = self.blocks.where(which).select("no", "n", "bits", "ids", F.col("rows").alias("b_rows"), F.col("labels").alias("b_labels"), "planes")
            asked = sent.repartition(self.parts, "no").join(blocks.repartition(self.parts, "no"), "no").drop("no")
            hits = asked.mapInArrow(_ask(self.dims, k, same), _FOUND)
            if best is not None:
                hits = hits.unionByName(best.drop("rank"))
            rank = F.row_number().over(Window.partitionBy("row", "w").orderBy(F.col("score").desc(), "vec_id", "c_row"))
            best = self.work.save(hits.withColumn("rank", rank).where(F.col("rank") <= k), f"{name}{i}")
            self.work.delete(*last)
            last = [f"{name}{i}", f"{name}-chunks{i}"]
        return best

    @staticmethod
    def _raised(anchors: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """The anchors with the lower end of windows of which k candidates are known at the k-th score: what lies below is not among the k best."""
        floors = best.where(F.col("rank") == k).groupBy(F.col("row").alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
        both = anchors.join(floors, F.col("row") == F.col("r"), "left").drop("r")
        return both.withColumn("lo", F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("floors", w), x))))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, scale: int = 256, low: int = 30, high: int = 90, block_rows: int = 2048, chunk_rows: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, embedding and label. Anchors are the rows whose vec_id is divisible by
    `every`; a row's score with one is the product of the vectors as integers floor(scale x), ties go to the smaller
    vec_id. An anchor's positives are the first rows of its label but itself; for each the first
    rows of other labels whose score lies between low and high percent of the positive's are returned.

    Rows with a null vec_id, label or vector, or a component that is null, NaN or infinite, take no part. Shorter vectors are
    filled with zeros. Rows that repeat a vec_id stand each for itself, as anchors, positives and negatives.
    Other columns are not read; an empty table gives no rows. Scores that need not fit a long raise an error.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "hard-negatives")
    e = F.transform("embedding", lambda x: x.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")).where(
        "vec_id is not null and label is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    clean = work.save(whole.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    total, dims = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    index = _Index(work, clean, total, max(1, dims or 0), block_rows, chunk_rows)
    anchors = clean.where(F.col("vec_id") % every == 0)
    ends = F.array(F.lit(_LOW)), F.array(F.lit(_HIGH))
    near = index.search(anchors.withColumn("lo", ends[0]).withColumn("hi", ends[1]), positives, True, "positives")
    # a window of scores for each positive; none for those below zero, whose ends cross
    ok = F.col("score") >= 0
    lo, hi = F.expr(f"({low} * score + 99) div 100"), F.expr(f"{high} * score div 100")
    window = F.struct("rank", F.when(ok, lo).otherwise(_HIGH).alias("lo"), F.when(ok, hi).otherwise(_LOW).alias("hi"))
    asked = near.groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_list(window)).alias("windows"), F.max(ok).alias("any")).where("any")
    windows = [F.slice(F.concat(F.transform("windows", lambda x: x[c]), F.array_repeat(F.lit(none), positives)), 1, positives).alias(c) for c, none in (("lo", _HIGH), ("hi", _LOW))]  # noqa: B023
    asking = work.save(anchors.join(asked, F.col("row") == F.col("r")).select("row", "label", "v", *windows), "asking")
    found = index.search(asking, negatives, False, "negatives")
    of = near.select(F.col("row").alias("r"), (F.col("rank") - 1).alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(of, (F.col("row") == F.col("r")) & (F.col("w") == F.col("at"))).join(anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")), F.col("row") == F.col("a_row"))
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (cast(label as long) + 1) % 10, cast(label as long))")))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, c) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id, s.c) AS rank
  FROM p JOIN s ON p.r = s.r WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

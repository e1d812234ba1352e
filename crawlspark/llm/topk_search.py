"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; in that order the
vectors are cut into blocks, each an annulus around its pivot that also knows its least and greatest
distance to every other pivot, and its norms. A query starts in its own annulus and goes on
through the others, sorted by what the triangle inequality lets them hold, in steps that grow;
it stops at the first whose bound is below its k-th score: with q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2
and |q - x| >= | |q - p| - |x - p| | for each pivot p (the largest gap counts), an annulus whose
bound is below a query's k-th score holds nothing for it. Of equal scores the smaller id ranks first, so an annulus
whose bound equals the k-th score counts only if it has smaller ids.

Scale: blocks, tiles of neighbouring blocks and chunks of queries have bounded sizes. What a
query asks is written as its place in its chunk and bits of annuli; a tile meets each chunk that
asks it once, with vectors in the narrowest integers that hold them. A tile that many chunks ask
is read in several tasks. The index is sorted by (pivot, distance, id), so equal vectors fill
blocks of their own that ids tell apart. The annuli that tasks look up are merged until they are
`max_annuli` at most, with two distances a pivot (at 64 pivots 8 MB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load

_BLOCK = "block_id long, pivot int, near array<double>, far array<double>, norm double, min_id long, n int, ids binary, rows binary, vecs binary"
#: What the queries of a chunk ask of a tile: their places, annuli as first and last block, bits (annulus, query).
_ASKED = "tile long, chunk long, pairs long, who binary, first binary, last binary, bits binary"
#: A chunk of queries: vec_ids, row numbers and vectors, and for each the k best: scores, vec_ids, row numbers.
_STATE = "chunk long, n int, ids binary, rows binary, vecs binary, scores binary, found binary, places binary"
_STATE_NAMES = ["ids", "rows", "vecs", "scores", "found", "places"]
_WORST = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A row per list, as long as dims; shorter lists are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def narrowest(top: float) -> str:
    """The narrowest integers that hold whole numbers up to top in size."""
    return next(t for t in ("int8", "int16", "int32", "int64") if top <= np.iinfo(t).max)


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot. Whole numbers below 2^53 on the way, so equal ones come out equal."""
    return np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] - 2 * (v @ pivots.T) + (pivots**2).sum(axis=1), 0))


def _keyed(pivots: np.ndarray, dims: int):

    def run(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column(1), dims), pivots)
            p = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["vec_id", "v", "row", "pivot", "dist"])

    return run


def _blocks(pivots: np.ndarray, dims: int, rows: int, code: str):
    types = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        parts: list[tuple] = []  # of the block that is open

        def close():
            nonlocal number
            ids, rows_of, v = (np.concatenate(x) for x in zip(*(p[1:] for p in parts)))
            d = _distances(v, pivots)
            order = np.argsort(ids, kind="stable")
            out = (base + number, parts[0][0], d.min(axis=0).tolist(), d.max(axis=0).tolist(), math.sqrt((v**2).sum(axis=1).max()), int(ids.min()), len(ids), ids[order].tobytes(), rows_of[order].tobytes(), v[order].astype(code).tobytes())
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, places, pivot = (batch.column(i).to_numpy() for i in (0, 2, 3))
            v = _matrix(batch.column(1), dims)
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if parts and parts[0][0] != pivot[a]:
                    yield close()
                    parts = []
                while a < b:
                    take = min(b - a, rows - sum(len(p[1]) for p in parts))
                    parts.append((int(pivot[a]), ids[a : a + take], places[a : a + take], v[a : a + take]))
                    a += take
                    if sum(len(p[1]) for p in parts) == rows:
                        yield close()
                        parts = []
        if parts:
            yield close()

    return run


def _best(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of v (ids ascending) for each query but its own row: scores, ids and rows, padded with the worst."""
    scores = (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    n = len(ids)
    keys = scores * n + np.arange(n - 1, -1, -1)  # of equal scores the smaller id is larger
    keys[q_rows[:, None] == rows[None, :]] = _WORST
    if n > k:
        keys = np.take_along_axis(keys, np.argpartition(keys, n - k, axis=1)[:, n - k :], axis=1)
    keys = -np.sort(-keys, axis=1) if keys.shape[1] else keys
    own = keys == _WORST
    at = n - 1 - keys % n
    pad = ((0, 0), (0, max(0, k - keys.shape[1])))
    out = ((np.where(own, _WORST, keys // n), _WORST), (np.where(own, _NO_ID, ids[at]), _NO_ID), (np.where(own, _NO_ID, rows[at]), _NO_ID))
    return tuple(np.pad(x, pad, constant_values=fill)[:, :k] for x, fill in out)


def _merge(s: np.ndarray, i: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((i, -s.astype(float), s == _WORST), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (s, i, r))


def _state_batch(chunk: int, *state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(state[0])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in state)], names=["chunk", "n", *_STATE_NAMES])


def _home(dims: int, k: int, every: int, chunk_rows: int, code: str):
    """The queries of a partition's blocks, each with the best of its own block."""

    def run(batches):
        base, number, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for ids, rows, vecs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, rows, v = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(vecs, code).reshape(-1, dims)
                asks = ids % every == 0
                if asks.any():
                    parts.append((ids[asks], rows[asks], v[asks], *_best(v[asks], rows[asks], v, ids, rows, k)))
                    if sum(len(p[0]) for p in parts) >= chunk_rows:
                        yield _state_batch(base + number, *(np.concatenate(x) for x in zip(*parts)))
                        number, parts = number + 1, []
        if parts:
            yield _state_batch(base + number, *(np.concatenate(x) for x in zip(*parts)))

    return run


def _open(state, dims: int, k: int, code: str):
    ids, rows, vecs, *best = state
    return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(vecs, code).reshape(-1, dims), *(np.frombuffer(x, np.int64).reshape(-1, k) for x in best)


def _states(batch, *names):
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))


class Annuli:
    """What tasks know of the annuli: part, first and last block, pivot, norm, least id, and distances to all pivots."""

    def __init__(self, rows: list, pivots: np.ndarray):
        rows = sorted(rows, key=lambda r: r["min_id"])  # of equal bounds, those with smaller ids first
        self.pivots = pivots
        self.part, self.first, self.last, self.pivot, self.min_id = (np.array([r[c] for r in rows], np.int64) for c in ("part", "lo", "hi", "pivot", "min_id"))
        self.norm = np.array([r["norm"] for r in rows], float)
        self.near, self.far = (np.array([r[c] for r in rows], float).reshape(len(rows), len(pivots)).T.copy() for c in ("near", "far"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest inner product that each annulus (a column) may hold for each query."""
        q = q.astype(float)
        q2 = (q**2).sum(axis=1)[:, None]
        dots, d = q @ self.pivots.T, _distances(q, self.pivots)
        size, gap, part = np.sqrt(q2), np.zeros((len(q), len(self.norm))), np.empty((len(q), len(self.norm)))
        bound = size * self.norm
        for p in range(len(self.pivots)):
            np.maximum(gap, np.subtract(d[:, p, None], self.far[p], out=part), out=gap)
            np.maximum(gap, np.subtract(self.near[p], d[:, p, None], out=part), out=gap)
            # q.x = q.p + q.(x - p)
            np.minimum(bound, np.add(dots[:, p, None], np.multiply(size, self.far[p], out=part), out=part), out=bound)
        bound = np.minimum(bound, (q2 + self.norm**2 - gap**2) / 2)
        return np.floor(bound + 1e-6 * (1 + np.abs(bound)))


def _route(annuli: Annuli, dims: int, k: int, code: str, lo: int, hi: int, per_tile: int):
    """Of the annuli that are lo-th to hi-th by bound for a query, those that may hold something for it, a row a chunk and tile."""
    tile = (annuli.part << 32) + annuli.first // per_tile  # annuli do not reach over the ends of tiles
    inside = {t: np.flatnonzero(tile == t) for t in np.unique(tile).tolist()}

    def run(batches):
        for batch in batches:
            for chunk, *state in _states(batch, "chunk", *_STATE_NAMES):
                _, _, q, s, i, _ = _open(state, dims, k, code)
                bound = annuli.bounds(q)
                may = np.zeros(bound.shape, bool)
                np.put_along_axis(may, np.argsort(-bound, axis=1, kind="stable")[:, lo:hi], True, axis=1)
                may &= (bound > s[:, -1:]) | (bound == s[:, -1:]) & (annuli.min_id < i[:, -1:])
                for t, at in inside.items():
                    at = at[may[:, at].any(axis=0)]
                    if not len(at):
                        continue
                    who = np.flatnonzero(may[:, at].any(axis=1)).astype(np.int32)
                    bits = may[np.ix_(who, at)].T
                    pairs = int((bits.sum(axis=1) * (annuli.last[at] - annuli.first[at] + 1)).sum())
                    packed = (who, annuli.first[at], annuli.last[at], np.packbits(bits, axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (t, chunk, pairs)] + [pa.array([x.tobytes()], pa.binary()) for x in packed], names=[x.split()[0] for x in _ASKED.split(", ")])

    return run


#: Rows of a tile: first its blocks (chunk null, number in first), then the chunks that ask it.
_TILE = "tile long, salt long, chunk long, number long, who binary, first binary, last binary, bits binary, ids binary, rows binary, vecs binary"


def _score(dims: int, k: int, code: str):
    """What each tile has for each chunk that asks it; its blocks come first."""

    def run(batches):
        tile, blocks = None, {}
        for batch in batches:
            for t, salt, chunk, number, who, first, last, bits, ids, rows, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, salt) != tile:
                    tile, blocks = (t, salt), {}
                v = np.frombuffer(vecs, code).reshape(-1, dims)
                if chunk is None:
                    blocks[number] = (v, np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64))
                    continue
                who, rows = np.frombuffer(who, np.int32), np.frombuffer(rows, np.int64)
                first, last = np.frombuffer(first, np.int64), np.frombuffer(last, np.int64)
                bits = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(first), -1), axis=1, count=len(who)).astype(bool)
                best = [np.full((len(who), k), fill, np.int64) for fill in (_WORST, _NO_ID, _NO_ID)]
                for a, b, asks in zip(first.tolist(), last.tolist(), bits):
                    q, q_rows = v[who[asks]], rows[who[asks]]
                    for n in range(a, b + 1):
                        found = _merge(*(np.concatenate([x[asks], y], axis=1) for x, y in zip(best, _best(q, q_rows, *blocks[n], k))), k)
                        for x, y in zip(best, found):
                            x[asks] = y
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([None], pa.int32()), pa.array([who.tobytes()], pa.binary()), none, none, *(pa.array([x.tobytes()], pa.binary()) for x in best)], names=["chunk", "n", *_STATE_NAMES])

    return run


def _gather(dims: int, k: int, code: str):
    """A chunk's state, then what blocks have found for it, one at a time."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, waiting = None, []
        chunk = key[0].as_py()
        for batch in batches:
            for n, *state in _states(batch, "n", *_STATE_NAMES):
                if n is not None:
                    got = [x.copy() for x in _open(state, dims, k, code)]
                    continue
                late = (np.frombuffer(state[0], np.int32), *(np.frombuffer(x, np.int64).reshape(-1, k) for x in state[3:]))
                if got is None:
                    waiting.append(late)
                else:
                    _apply(got, late, k)
        for late in waiting:
            _apply(got, late, k)
        yield _state_batch(chunk, *got)

    return run


def _apply(got, late, k: int) -> None:
    who, s, i, r = late
    again = (r[:, :, None] == got[5][who][:, None, :]).any(axis=2)  # a query's own annulus comes again
    late = (np.where(again, _WORST, s), np.where(again, _NO_ID, i), np.where(again, _NO_ID, r))
    got[3][who], got[4][who], got[5][who] = _merge(*(np.concatenate([a[who], b], axis=1) for a, b in zip(got[3:], late)), k)


def _answers(dims: int, k: int, code: str):
    def run(batches):
        for batch in batches:
            for state in _states(batch, *_STATE_NAMES):
                ids, _, _, s, i, _ = _open(state, dims, k, code)
                ok = s != _WORST
                row, rank = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((rank + 1).astype(np.int32)), pa.array(i[ok]), pa.array(s[ok])], names=["query_id", "rank", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, n_pivots: int = 64, block_rows: int = 2048, chunk_rows: int = 1024, max_annuli: int = 8192, first: int = 2, tile_blocks: int = 16, tile_chunks: int = 512, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`, against all other rows.

    vectors has vec_id and embedding, whose components x count as floor(64 x). Vectors
    that are null or hold null, NaN or infinite components take no part, nor does a null
    vec_id. Shorter vectors are filled with zeros. Rows that repeat a vec_id are queries and
    candidates each for itself, and the others are among a query's candidates. Of equal scores
    the smaller vec_id ranks first. Scores are exact; vectors whose scores might reach
    2^52 / block_rows raise ValueError. Other columns are
    not read; an empty table gives no rows. The pivots are a sample of n_pivots vectors by hash.
    A query takes its `first` most promising annuli, then eight times as many, and so on.
    A tile is `tile_blocks` blocks at most, read by a task for each `tile_chunks` chunks of queries.
    seen is filled with pairs of query and block: `all` there are, `scored` after each step.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "top-k")
    e = F.transform("embedding", lambda x: x.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    clean = work.save(whole.select("vec_id", F.transform("e", lambda x: F.floor(x * 64).cast("double")).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    dims, total, top = clean.agg(F.max(F.size("v")), F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, top = max(dims or 0, 1), top or 0.0
    if dims * top**2 * block_rows >= 1 << 52:
        raise ValueError(f"components up to {top / 64:g} in {dims} dimensions: scores would not be exact")
    code = narrowest(top)
    pivots = np.zeros((max(1, min(n_pivots, total)), dims))
    for row, (v,) in zip(pivots, clean.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).select("v").collect()):
        row[: len(v)] = v
    parts = max(1, min(math.ceil(total / (4 * block_rows)), 100_000))
    keyed = clean.mapInArrow(_keyed(pivots, dims), "vec_id long, v array<double>, row long, pivot int, dist double")
    index = work.save(keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id").mapInArrow(_blocks(pivots, dims, block_rows, code), _BLOCK), "index")
    # annuli: blocks that follow each other in a tile and share a pivot, merged to be few
    n_blocks = index.count()
    per = max(1, math.ceil(n_blocks / max_annuli))
    per_tile = per * math.ceil(tile_blocks / per)
    place = F.shiftright("block_id", 32)
    number = F.col("block_id").bitwiseAND(0xFFFFFFFF)
    distances = [F.array(*(f(F.col(c)[p]) for p in range(len(pivots)))).alias(c) for f, c in ((F.min, "near"), (F.max, "far"))]
    merged = index.groupBy(place.alias("part"), "pivot", F.floor(number / per).alias("g")).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.max("norm").alias("norm"), F.min("min_id").alias("min_id"), *distances)
    annuli = Annuli(merged.drop("g").collect(), pivots)
    state = work.save(index.select("ids", "rows", "vecs").mapInArrow(_home(dims, k, every, chunk_rows, code), _STATE), "home")
    salts = math.ceil(state.count() / tile_chunks)
    if seen is not None:
        seen |= {"all": (state.agg(F.sum("n")).first()[0] or 0) * n_blocks, "scored": []}
    none = F.lit(None)
    blocks = index.select(
        (F.shiftleft(place, 32) + F.floor(number / per_tile)).alias("tile"), F.explode(F.expr(f"sequence(0L, {max(1, salts) - 1}L)")).alias("salt"), none.cast("long").alias("chunk"), number.alias("number"),
        *(none.cast("binary").alias(c) for c in ("who", "first", "last", "bits")), "ids", "rows", "vecs",
    )
    lo, hi, last = 0, first, "home"
    while lo < len(annuli.norm):
        asked = work.save(state.mapInArrow(_route(annuli, dims, k, code, lo, hi, per_tile), _ASKED), f"asked{lo}")
        if asked.isEmpty():  # annuli come by falling bounds: no query has any left
            break
        if seen is not None:
            seen["scored"].append(asked.agg(F.sum("pairs")).first()[0])
        queries = asked.join(state.select(F.col("chunk").alias("c"), "rows", "vecs"), F.col("chunk") == F.col("c"))
        queries = queries.select("tile", F.pmod(F.xxhash64("chunk"), F.lit(max(1, salts))).alias("salt"), "chunk", none.cast("long").alias("number"), "who", "first", "last", "bits", none.cast("binary").alias("ids"), "rows", "vecs")
        wanted = blocks.join(asked.select(F.col("tile").alias("t")).distinct(), F.col("tile") == F.col("t"), "left_semi")
        rows = wanted.unionByName(queries).repartition(parts * max(1, salts), "tile", "salt").sortWithinPartitions("tile", "salt", F.col("chunk").asc_nulls_first())
        found = rows.select(*(x.split()[0] for x in _TILE.split(", "))).mapInArrow(_score(dims, k, code), _STATE)
        state = work.save(state.unionByName(found).groupBy("chunk").applyInArrow(_gather(dims, k, code), _STATE), f"state{lo}")
        work.drop(last, f"asked{lo}")
        last = f"state{lo}"
        lo, hi = hi, 9 * hi
    return state.mapInArrow(_answers(dims, k, code), "query_id long, rank int, vec_id long, score long")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

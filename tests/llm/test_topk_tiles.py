"""Tiles, merged annuli and bounds of the exact top-k search."""

from collections import Counter

import numpy as np
import pytest

from crawlspark.llm import topk_search


def _want(ids, v, every, k):
    ints = np.floor(64 * v).astype(int)
    scores = ints @ ints.T
    out = Counter()
    for q in np.flatnonzero(np.array(ids) % every == 0):
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-scores[q, i], ids[i]))[:k]
        out += Counter((ids[q], n + 1, ids[i], int(scores[q, i])) for n, i in enumerate(order))
    return out


def _clustered(n=1200, dims=8, seed=4):
    r = np.random.default_rng(seed)
    centers = np.eye(dims) * 3
    return np.float32(centers[r.integers(0, dims, n)] + r.normal(size=(n, dims)) * 0.05).astype(float)


@pytest.mark.parametrize("options", [{}, {"max_annuli": 12}, {"tile_blocks": 1, "tile_chunks": 2}])
def test_tiles_and_merged_annuli(spark, options):
    v = _clustered()
    base = 1 << 60  # ids that floats cannot tell apart
    ids = [base + i for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(3)
    seen = {}
    got = topk_search.top_k(df, k=5, every=16, n_pivots=16, block_rows=16, chunk_rows=8, seen=seen, **options)
    assert Counter(map(tuple, got.collect())) == _want(ids, v, 16, 5)
    if not options:  # clusters of their own: most blocks are never scored
        assert sum(seen["scored"]) < seen["all"] / 2


def test_bounds_hold(spark):
    r = np.random.default_rng(9)
    v = np.floor(64 * r.normal(size=(300, 6)))
    pivots = v[:5]
    rows = []
    for i in range(0, 300, 30):
        d = topk_search._distances(v[i : i + 30], pivots)
        rows.append({"part": 0, "lo": i, "hi": i, "pivot": 0, "norm": float(np.sqrt((v[i : i + 30] ** 2).sum(axis=1).max())), "min_id": i, "near": d.min(axis=0).tolist(), "far": d.max(axis=0).tolist()})
    annuli = topk_search.Annuli(rows, pivots)
    bound = annuli.bounds(v)
    best = np.stack([(v @ v[i : i + 30].T).max(axis=1) for i in annuli.first], axis=1)
    assert (bound >= best).all()


def test_scores_that_are_not_exact_are_refused(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="exact"):
        topk_search.top_k(df)


def test_narrowest():
    assert [topk_search.narrowest(x) for x in (0, 127, 128, 40000, 1 << 40)] == ["int8", "int8", "int16", "int32", "int64"]

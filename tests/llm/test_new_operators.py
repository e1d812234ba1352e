"""Hard negatives, personal data and centroid clustering against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspark.llm import centroid_clustering, hard_negatives, pii

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int, row string, rows string, v string, part int, no long, block int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 1, 1) for r in rows], SCHEMA).repartition(parts)


def made(n, dims, seed, labels=3):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.uniform(-1, 1), r.uniform(-0.01, 0.01), 0.5]) for _ in range(dims)], 0 if r.random() < 0.4 else r.randrange(labels)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % labels) for i in range(20)]  # ties
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (5, rows[9][1], 0)]  # repeated ids
    rows += [(None, rows[0][1], 1), (9001, None, 1), (9002, [0.1] * dims, None), (9003, [], 0), (9004, [0.1, None], 0), (9005, [NAN] * dims, 0), (9006, [INF] * dims, 0), (9007, [-INF] * dims, 0), (9100, [0.25], 2)]
    return rows


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_negatives(rows, positives, negatives, every, low=30, high=90):
    dims = max(len(v) for i, v, _ in rows if finite(v))
    kept = [(i, np.array([int(np.floor(256 * x)) for x in v] + [0] * (dims - len(v))), lab) for i, v, lab in rows if i is not None and lab is not None and finite(v)]
    out = []
    for a, (i, x, lab) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-int(x @ y), j, m) for b, (j, y, m) in enumerate(kept) if b != a)
        for s, p, _ in [t for t in scored if t[2] == lab][:positives]:
            inside = [t for t in scored if t[2] != lab and low * -s <= 100 * -t[0] <= high * -s]
            out += [(i, p, rank, j, -s, -n) for rank, (n, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk,every", [(16, 8, 4), (4096, 1024, 10), (3, 2, 25)])
def test_hard_negatives(spark, block, chunk, every):
    rows = made(220, 12, every)
    got = hard_negatives.hard_negatives(vectors(spark, rows), 3, 4, every, block_rows=block, chunk_rows=chunk).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 3, 4, every) and got


def test_hard_negatives_of_little(spark):
    assert hard_negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, [-1.0, 0.0], 1), (4, [0.95, 0.0], 2)]
    assert [tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()] == [(100, 1, 1, 2, 256 * 256, 128 * 256)]


def test_wide_components_stay_exact():
    r = np.random.default_rng(1)
    for top in (1, 300, 2**40):
        v, a = r.integers(-top, top, (50, 9)), r.integers(-300, 300, (6, 9))
        bits, planes = hard_negatives.slice_bits(v)
        s = a @ v.T
        lo, hi = np.full((6, 1), hard_negatives._LOW), np.full((6, 1), hard_negatives._HIGH)
        ai, ci, got, left = hard_negatives.qualify(a, lo, hi, np.ones((6, 50), bool), bits, planes, 3)
        assert (got == s[ai, ci]).all() and left == sorted(left, reverse=True)
        for i in range(6):
            assert sorted(got[ai == i])[-3:] == sorted(s[i])[-3:]
    with pytest.raises(ValueError):
        hard_negatives.qualify(np.full((1, 9), 2**30), lo[:1], hi[:1], np.ones((1, 50), bool), bits, planes, 3)


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows if finite(v) and len(v) == dims]
    h = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda t: (*h(t[0]), t[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in last if j == x) for x in range(len(c))]
    return sorted(((i, j, d, inertia[j], sum(inertia)) for i, d, j in last), key=str), c


@pytest.mark.parametrize("rounds,scale,block", [(0, 64, 7), (3, 4, 2048), (12, 64, 16), (4, 10**6, 16)])
def test_clusters(spark, rounds, scale, block):
    rows = made(150, 5, rounds)
    got, c = centroid_clustering.cluster(vectors(spark, rows), 6, rounds, 5, scale, block_rows=block, bucket_blocks=2)
    want, centroids = brute_clusters(rows, 6, rounds, 5, scale)
    assert sorted(map(tuple, got.collect()), key=str) == want and c == centroids
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_clusters_of_little(spark):
    assert centroid_clustering.cluster(vectors(spark, []))[0].collect() == []
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [0.5], 0)]
    got, c = centroid_clustering.cluster(vectors(spark, rows), 8, 10, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)] and c == [[512, 512]] * 2
    with pytest.raises(ValueError):
        centroid_clustering.cluster(vectors(spark, [(1, [1e9, 0.0], 0)]), 8, 1, 2)


def test_a_round_compares_only_what_it_must():
    r = np.random.default_rng(2)
    for _ in range(200):
        v, c = r.integers(-9, 9, (40, 3)), r.integers(-9, 9, (5, 3))
        d = centroid_clustering.distances(v, c)
        owner = d.argmin(axis=1)
        changed = r.random(5) < 0.4
        c2 = np.where(changed[:, None], c + r.integers(-3, 4, (5, 3)), c)
        got = centroid_clustering.reassign(v, c2, changed, owner, d[np.arange(40), owner])
        full = ((v[:, None] - c2) ** 2).sum(axis=2)
        assert (got[0] == full.argmin(axis=1)).all() and (got[1] == full.min(axis=1)).all()


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute_base(t):
    found = [(m.start(), list(PLAIN).index(k), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x@y", "é😀 mail jo.e+x@ex-ample.co.uk, and ß 10.0.0.255", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4222222222222",
    "card: 4222222222222, and then far behind it isbn 4222222222222", "call +44 (0)20 7946-0958 or +1 2 or +999999999999999999", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; DE88 3704 0044 0532 0130 00 XDE89370400440532013000",
    "SSN 123-45-6789, 123-45-6788 and 000-12-3456 social security 1-123-45-6789", "+1.2.3.4.5.6.7.8.9.10 +10.20.30.40.50", "@@@ a@b a@b. a@-.- %@%.x",
]


def fuzz(n):
    r = random.Random(5)
    parts = ["a@b.c", "@", ".", "_", "-", " ", "+", "4111111111111111", "1", "22", "255", "256", "(", "é", "😀", "\n", "x.y@z.w", "+49 30 1234567", "10.1.2.3", "ssn"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_pii(spark):
    texts = TEXTS + fuzz(1500)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, "a@b.c"), (1, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("row", "spans", "kind", "i", "p", "end", "c", "m_email", "g", "_g"))).repartition(5)
    got = pii.pii_scan(df).collect()
    norm = lambda i, base: (str(i), str(base))
    assert sorted(norm(x.doc_id, [(s.kind, s.start, s.end) for s in x.spans if s.base]) for x in got) == sorted(norm(i, brute_base(t or "")) for i, t in rows)
    for x in got:
        assert all(s.text == texts[x.doc_id][s.start : s.end] for s in x.spans) if x.doc_id and x.doc_id > 1 else True
    of = {x.doc_id: [(s.kind, s.text) for s in x.spans if not s.base] for x in got if x.doc_id}
    assert of[7] == [("card13", "4222222222222")] and of[6] == []
    assert of[10] == [("ssn", "123-45-6789")]
    near = {x.doc_id: x.spans for x in got}[8]
    assert near[0].kind == "phone" and near[0].score == 0.9
    assert pii.pii_scan(df.limit(0)).collect() == []


def test_iban_needs_its_check_and_stands_alone(spark):
    got = pii.pii_scan(spark.createDataFrame([(1, TEXTS[9])], "doc_id long, text string")).first()
    assert [(s.kind, s.text) for s in got.spans] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]


def test_redaction_masks_what_the_scan_finds(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "mail a@b.co now"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_m", F.lit(3))
    got = {r.doc_id: r for r in pii.redact_pii(df).collect()}
    assert pii.redact_pii(df).columns == df.columns and got[0].text is None and got[1].text == "" and got[2].text == "no data" and got[2]._m == 3
    assert got[len(TEXTS)].text == "mail [EMAIL] now"
    assert got[9].text == "IBAN [IBAN], [IBAN]; DE88 3704 0044 0532 0130 00 XDE89370400440532013000"
    again = pii.pii_scan(pii.redact_pii(df)).collect()
    assert not [s for x in again for s in x.spans if s.base]


def test_pii_is_linear_in_long_texts(spark):
    long = ["a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "+1" * 1_000_000, "a@b.c " * 200_000, "+1 " + "(" * 2_000_000, "A" * 2_000_000, "AB12 " + "ABCD " * 300_000, "a@b" + ".c" * 700_000]
    got = {x.doc_id: len([s for s in x.spans if s.base]) for x in pii.pii_scan(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4)).select("doc_id", "spans").collect()}
    assert got[5] == 200_000 and got[9] == 1 and got[0] == got[1] == 0

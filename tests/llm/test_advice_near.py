"""Rows with null and repeated ids, and slices of few words, in the n-gram join."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from crawlspark.llm import ngram_join


def test_near_stage_keeps_one_row_of_a_component(spark):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(None, a), (None, a + " one"), (7, a + " two"), (5, b), (5, b + " one"), (5, c), (None, d), (6, d + " one"), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = C.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    got = [(x.doc_id, x.text) for x in got.collect()]
    of = lambda t: [x for x in got if x[1] and x[1].startswith(t)]
    assert [len(of(t)) for t in (a, b, c, d)] == [1] * 4
    assert of(a)[0][0] is None and of(d) == [(None, d)] and of(c) == [(5, c)]
    assert len(got) == 6  # texts without words are linked with nothing


def test_shingles_of_fewer_words_than_n():
    for words in range(8):
        for n in (4, 5):
            got = ngram_join.shingle_sets(pa.array([" ".join("abcdefgh"[:words])]), n)
            assert [len(s) for s in got] == [max(1, words - n + 1) if words else 0]
            assert got[0].dtype == np.uint64

"""What a Python worker of the pipeline holds: batches and slices are bounded, words go after a task, no workers for local rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlspark.llm import language_id, packing
from crawlspark.llm.common import text_slices


def test_slices_are_bounded_by_rows_too():
    batch = pa.RecordBatch.from_pydict({"text": ["short"] * 1000 + [None, "x" * 9000]})
    slices = list(text_slices([batch], 0, 4096, 128))
    assert max(s.num_rows for s in slices) == 128
    assert pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch]))


def test_predictions_hold_few_vectors_at_once(spark, monkeypatch):
    docs = spark.range(600, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the words of number"), "id").alias("text"), F.lit("en").alias("lang"))
    model = language_id.fit(docs)

    def counted(texts, dims=language_id.DIMS, real=language_id.vectors):
        if len(texts) > 128:
            raise AssertionError(f"{len(texts)} vectors at once")
        return real(texts, dims)

    monkeypatch.setattr(language_id, "vectors", counted)
    batch = pa.RecordBatch.from_pydict({"text": ["the words of number one"] * 5000})
    captured = {}

    class Docs:
        columns = ["text"]
        schema = docs.select("text").schema

        def drop(self, *_):
            return self

        def mapInArrow(self, run, schema):
            captured["run"] = run
            return self

    language_id.identify(Docs(), model)
    assert sum(b.num_rows for b in captured["run"]([batch])) == 5000


def test_long_texts_come_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id")), 1000).alias("text"))
    try:
        corpus_pipeline.secret_stage(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r.n for r in sizes) > 20 << 20
    assert max(r.n for r in sizes) < 6 << 20


def test_words_go_after_a_task(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words to be learned", "and more"]})
    first = list(packing._cut(path, 2048, 0)([batch]))
    assert len(packing._encoder_of(path).at) == 1
    assert [x.to_pylist() for x in packing._cut(path, 2048, 0)([batch])] == [x.to_pylist() for x in first]

"""What learning languages takes of the driver's memory."""

import random
import tracemalloc

from crawlspark.llm import language_id


def test_fit_unpacks_one_language_at_a_time(spark):
    r = random.Random(8)
    rows = []
    for lang in "abcdefgh":
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(300)]
        rows += [(len(rows) + i, " ".join(r.choices(words, k=30)), lang) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").localCheckpoint()
    tracemalloc.start()
    try:
        model = language_id.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(set(model.langs)) == list("abcdefgh")
    assert language_id.identify(docs, model).where("lang_pred = lang").count() == len(rows)
    assert peak < 2 * len(rows) * language_id.DIMS * 4  # of all vectors

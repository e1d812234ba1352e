"""Classes that share a passage and are many small components: the last step of the n-gram join."""

import random

import pytest

from crawlspark.llm import ngram_join


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def components(texts, n, num, den):
    sets = [{tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("tree", [1, 4])  # blocks of 4 and 16 classes, many at a hash
def test_shared_passages_of_many_lengths(spark, tree):
    r = random.Random(7)
    passages = [words(r, 60), words(r, 25)]
    texts = []
    for _ in range(180):  # from a third to nine tenths of a text is shared
        w = r.choice(passages) + words(r, r.choice([3, 6, 9, 12, 15, 40]))
        texts.append(w)
        for _ in range(r.choice([0, 0, 1, 2])):  # chains of edits, near the threshold
            w = list(w)
            for _ in range(r.choice([1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
            texts.append(w)
    r.shuffle(texts)
    texts = [" ".join(w) for w in texts] + ["", "a", "a b", "a b", "passage"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in ngram_join.similar_components(docs, n=4, num=80, den=100, tree=tree).collect()}
    want = components(texts, 4, 80, 100)
    assert got == dict(enumerate(want))
    assert 100 < len(set(want)) < len(texts) - 50


def test_one_hash_in_twenty_thousand_small_components(spark):
    r = random.Random(8)
    shared, rows = ["this", "is", "common", "ground"], []
    for i in range(10_000):
        own = words(r, r.randrange(14, 30))
        rows.append((2 * i, " ".join(own + shared)))
        rows.append((2 * i + 1, " ".join([*own, *shared, "and", "more"]) if i % 2 else " ".join([*words(r, 14), *shared])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in ngram_join.similar_components(docs, n=4, num=85, den=100).collect()}
    assert got == {d: d - 1 if d % 2 and d // 2 % 2 else d for d, _ in rows}


def test_low_threshold_on_tiny_sets(spark):
    texts = ["a", "a b", "a b c", "c", "c d", "e f g h", "e f g", "x", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.similar_components(docs, n=1, num=50, den=100, tree=1).collect()}
    assert got == dict(enumerate(components(texts, 1, 50, 100)))

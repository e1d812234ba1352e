"""Hashes of words by columns of eight bytes, and what the sets made of them cost."""

import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from crawlspark.llm import ngram_join


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_different_words_have_different_hashes(kind):
    r = random.Random(5)
    words = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 511, 512, 513, 600]))) for _ in range(2000) for letters in ("ab", "ab\0", "abé中\0")]
    words = ["", "\0", "\0\0", "a", "a\0", *words]
    hashes = ngram_join.word_hashes(pa.array(["skipped", *words], kind).slice(1)).tolist()
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(of.values())) == len(of)


def test_sets_are_those_of_word_sequences():
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "B", "b", "cc", "É", "é", "x" * 600, "\x0b"]) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9, 40]))) for _ in range(500)]
    of = {}
    for text, got in zip([None, "", " \t", *texts], ngram_join.shingle_sets(pa.array([None, "", " \t", *texts]), 4)):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
        assert len(want) == len(got) and list(got) == sorted(set(got.tolist()))
        assert of.setdefault(want, got.tolist()) == got.tolist()
    assert len(set(map(tuple, of.values()))) == len(of)


def test_sets_cost_a_few_times_what_splitting_costs():
    r = random.Random(7)
    texts = pa.array([" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(600)) for _ in range(600)])

    def seconds(f):
        began = time.process_time()
        f(texts)
        return time.process_time() - began

    split = min(seconds(pc.ascii_split_whitespace) for _ in range(5))
    assert min(seconds(lambda t: ngram_join.shingle_sets(t, 4)) for _ in range(5)) < 10 * split

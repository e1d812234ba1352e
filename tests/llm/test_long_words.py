"""Words of any length through the recursive query, against the library that the vocabulary is of."""

import base64
import random

import pyarrow as pa
import pytest

from crawlspark.llm.byte_bpe import Codec


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(path, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), path, P.PATTERN


def same(codec, whole, text):
    n, ids, back = codec.encode(pa.array([text]))
    codec.forget()
    want = whole.encode_ordinary(text)
    assert ids[0].split() == [str(x).encode() for x in want] and n[0] == len(want) and back[0] == text.encode()


def letters(alphabet, n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def test_joints_of_stretches(both):
    """Short stretches, so that there are many joints: random, periodic and mixed words."""
    _, whole, path, pattern = both
    codec = Codec(path, pattern, stretch=24)
    r = random.Random(4)
    for k in range(120):
        alphabet = r.choice(["ab", "ACGT", "abcdefghijklmnopqrstuvwxyz", "aé漢", "theinatr", "x"])
        unit = letters(alphabet, r.randint(1, 9), k)
        text = r.choice([letters(alphabet, r.randint(50, 700), k), unit * r.randint(30, 90), letters(alphabet, 90, k) + unit * 40 + letters(alphabet, 80, k + 1)])
        same(codec, whole, text)


@pytest.mark.parametrize("text", ["a" * 3_000_000, "abc" * 1_000_000, letters("abcdefghijklmnopqrstuvwxyz", 3_000_000), letters("ACGT", 100_000)], ids=["one letter", "periodic", "random", "four letters"])
def test_words_of_megabytes(both, text):
    same(both[0], both[1], text)

"""Anchors are found a block of windows at a time."""

import random
import tracemalloc

import numpy as np
import pytest

from crawlspark.llm import suffix_dedup


def _brute(texts, length, gram):
    out, base = [], 0
    for d, text in enumerate(texts):
        h = suffix_dedup.gram_hashes(np.frombuffer(text, np.uint8), gram).tolist()
        for s in range(len(text) - length + 1):
            at = min(range(s, s + length - gram + 1), key=lambda i: (h[i] >> 32, i))
            if out and out[-1][0] == d and out[-1][3] == base + at:
                out[-1][2] = base + s
            else:
                out.append([d, base + s, base + s, base + at, h[at]])
        base += len(text)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 15])
@pytest.mark.parametrize(("length", "gram"), [(20, 8), (16, 16), (40, 4)])
def test_runs_are_those_of_each_window(block, length, gram):
    r = random.Random(9)
    texts = [bytes(r.choices(r.choice([b"ab", b"a", bytes(range(256))]), k=r.choice([0, 1, length - 1, length, length + 1, 3 * length, 200]))) for _ in range(30)]
    for part in (texts, [b""], [], texts[:1], [b"", b"x" * length, b""]):
        *got, data = suffix_dedup.anchors(part, length, gram, block)
        assert list(zip(*(x.tolist() for x in got))) == _brute(part, length, gram)
        assert data.tobytes() == b"".join(part)


def test_no_arrays_as_long_as_the_texts():
    text = np.random.default_rng(10).integers(97, 123, 2 << 20, np.uint8).tobytes()
    tracemalloc.start()
    try:
        suffix_dedup.anchors([text], 400, 128)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * len(text)  # a 64-bit number a byte

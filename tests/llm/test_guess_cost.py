"""The guess cost against all segmentations, and repetitions against all stretches."""

import math
import random
from functools import cache

import pytest

from crawlspark.llm import secret_scan as S


def brute_force(value):
    low = value.lower()
    leet = low.translate(S._LEET)
    rank_of, _ = S.ranks()

    def segment(i, j):
        costs, n = [], j - i
        if n == 1:
            costs.append(S._brute(value[i]))
        if n >= 3 and (rank := rank_of.get(low[i:j]) or rank_of.get(leet[i:j])):
            costs.append(math.log10(rank + 1) + math.log10(2) * (1 + (value[i:j] != low[i:j]) + (low[i:j] not in rank_of)))
        if n >= 4 and S._DATE.fullmatch(value[i:j]):
            costs.append(math.log10(365 * 120 if n > 4 else 120) + math.log10(2))
        if n >= 3 and all((a, b) in S._NEXT for a, b in zip(low[i:j], low[i + 1 : j])):
            costs.append(math.log10(40) + 1 + math.log10(2))
        for u in range(1, n // 2 + 1):
            if n >= 3 and n % u == 0 and value[i:j] == value[i : i + u] * (n // u):
                costs.append(sum(map(S._brute, value[i : i + u])) + 1 + math.log10(2))
        return min(costs, default=math.inf)

    @cache
    def best(j):
        return min((best(i) + segment(i, j) for i in range(j)), default=0.0)

    return best(len(value))


FIXED = ["", "a", "aa", "aaa", "Xk9#mQ2$vLaXk9#mQ2$vLa", "abcabcabcabd", "aaaaasdfgh", "P4ssw0rd1999-12-31", "2024010119991", "31.12.99qwerty", "1.1.2001", "xxxxyxxxxyxxxxy", "abab", "zxcvbnmlkjhg", "éééé", "passwordpassword", "qwertyytrewq", "aabaabaaab"]


@pytest.mark.parametrize("value", FIXED)
def test_fixed_values(value):
    assert S.guess_cost(value) == pytest.approx(brute_force(value))


def test_random_values():
    r = random.Random(8)
    for letters in ("ab", "abc", "asdf12", "qwertyuiop1290-./", "Pa4s5w0rd", "xk#9Qé"):
        for _ in range(150):
            value = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
            if r.random() < 0.5:
                value = value * r.randint(1, 3) + r.choice(["", "1999", "love", "aaaa"])
            assert S.guess_cost(value) == pytest.approx(brute_force(value)), value


def test_repetitions():
    r = random.Random(3)
    for _ in range(400):
        s = "".join(r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randint(0, 24)))
        want = set()
        for p in range(1, len(s) // 2 + 1):
            i = 0
            while i + p < len(s):
                j = i
                while j + p < len(s) and s[j] == s[j + p]:
                    j += 1
                if j - i >= p and not any(p % q == 0 and s[i : j + p] == (s[i : i + q] * len(s))[: j + p - i] for q in range(1, p)):
                    want.add((i, j + p, p))
                i = max(j, i + 1)
        got = S.repetitions(s)
        assert want <= set(got), s
        for a, b, p in set(got) - want:  # a multiple of the least period
            assert any((a, b, q) in want for q in range(1, p) if p % q == 0)


def test_long_values_take_time_in_proportion():
    assert S.guess_cost("a" * 200_000) < 4
    assert S.guess_cost("Xk9#mQ2$vL" * 20_000) == pytest.approx(S.guess_cost("Xk9#mQ2$vL" * 2))
    r = random.Random(1)
    assert S.guess_cost("".join(r.choice("abcXYZ019+/") for _ in range(30_000))) > 1000

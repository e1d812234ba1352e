"""Secret scans: fixed patterns, and values in credential context whose guess cost is high.

A value that follows a credential word (`passphrase: ...`, `login is ...`) is segmented
by dynamic programming into dictionary words, dates, repeats, keyboard walks or
sequences, and brute-force characters, at the least total log10 of guesses, exactly. A value
that still costs `min_log10` or more is a secret, and its span is added to those of the
patterns; `password = changeme2024` has a low cost and adds none.

Scale: one narrow pass without a shuffle; an RE2 filter over the Arrow column decides
which texts the exact patterns read, and the dynamic programming sees values only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_slices

KINDS = ("assign", "access", "hex", "guess")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider than ASSIGN: more names, more ways to say "is", any value without white space.
_CREDENTIALS = ("passphrase", "passcode", "password", "passwd", "pwd", "secret", "token", "credentials", "credential", "bearer", "login", "pin code", "private key", "access key", "api key", "api_key", "apikey", "auth key")
CONTEXT = re.compile(r"(?:" + "|".join(map(_either_case, _CREDENTIALS)) + r""")["']?(?:\s{0,3}(?:[:=]|->|=>)\s{0,3}|\s{1,3}(?:is|was)\s{1,3})["'`]?([^\s"'`<>]{6,})""")
_VALUE = re.compile(r"""[^\s"'`<>]*""")
_MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)"
_MAY_CONTEXT = "(?i)(" + "|".join(_CREDENTIALS) + ")"  # the names alone: RE2 and Python differ in what is white space

#: Words that people and sample files use as values, most common first; they go before those of ranks().
WORDS = (
    "password secret admin welcome letmein changeme test example default token qwerty monkey dragon master login user"
    " root guest pass hello shadow sunshine princess football baseball iloveyou trustno superman batman starwars"
    " summer winter spring autumn monday friday january october december love money access system server database"
    " secure private public key api auth sample dummy placeholder your my the this here none null true false value"
    " redacted hidden insert enter fill todo demo temp temporary local localhost dev prod staging"
).split()
_LEET = str.maketrans("4@3$510!7+", "aaessioitt")
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2]|[1-9])", r"(?:0[1-9]|[12]\d|3[01]|[1-9])"
_DATE = re.compile(rf"{_YEAR}|{_YEAR}([-/.]?){_MONTH}\1{_DAY}|{_DAY}([-/.]){_MONTH}\2(?:{_YEAR}|\d\d)", re.A)


def date_ends(value: str, start: int) -> list[int]:
    """Ends of the years and whole dates that start at a place."""
    if not value[start : start + 1].isdigit():
        return []
    return [end for end in range(start + 4, min(start + 10, len(value)) + 1) if _DATE.fullmatch(value, start, end)]


_KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _KEY_ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _KEY_ROWS for a, b in zip(row, row[1:])}


@cache
def ranks() -> tuple[dict[str, int], int]:
    """Rank of each word, and the length of the longest.

    WORDS, and what is of three letters or more in two public vocabularies whose ids
    go from frequent to rare: words and their parts of word_bpe_49k.json (English) and of
    byte_bpe_multi_50k.tiktoken (many languages); the least id of both counts. 51,000 in all.
    """
    import public_tokenizers

    found: dict[str, int] = {}

    def add(word: str, rank: int) -> None:
        word = word.lower()
        if len(word) >= 3 and word.isalpha():
            found[word] = min(rank + 1, found.get(word, rank + 1))

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        for token, rank in json.load(f)["model"]["vocab"].items():
            add(token.removesuffix("</w>"), rank)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        for token, rank in map(bytes.split, f):
            add(base64.b64decode(token).decode("utf-8", "replace").removeprefix(" "), int(rank))
    found |= {w: i + 1 for i, w in enumerate(WORDS)}
    return found, max(map(len, found))


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


#: log10 of the guesses for where a segment ends, for the length of a run of its own and for the start of a keyboard walk.
_JOIN, _LENGTH, _WALK = math.log10(2), 1.0, math.log10(40)


def _agree(value: str, i: int, j: int) -> int:
    """How many characters from i and from j (later) on are the same."""
    n, low, step = len(value), 0, 16
    while j + low < n and value[i + low : i + low + step] == value[j + low : j + low + step]:
        low += step
        step *= 2
    if j + low >= n:
        return n - j
    while step > 1:  # the first difference is within the next step characters
        step = (step + 1) // 2
        if value[i + low : i + low + step] == value[j + low : j + low + step]:
            low += step
    return min(low, n - j)


def repetitions(value: str) -> list[tuple[int, int, int]]:
    """All maximal stretches (start, end, period) that hold their least period twice or more; some of another period of them may come, too.

    A stretch of period p meets two places p apart that are multiples of p, so those are
    compared: n/p for each p.
    """
    n, back, out = len(value), value[::-1], []
    chars = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    period, until = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the stretch over each place that ends last
    for p in range(1, n // 2 + 1):
        at = np.arange(0, n - p, p)
        at = at[chars[at] == chars[at + p]]
        if not len(at):
            continue
        within = period[at]
        at = at[(within == 0) | (p % np.maximum(within, 1) != 0) | (until[at] <= at + p)]  # else a multiple of a lesser period
        end = 0
        for i in at.tolist():
            if i + p < end:
                continue
            start, stop = i - (_agree(back, n - i - p, n - i) if i else 0), i + p + _agree(value, i, i + p)
            if stop - start >= 2 * p:
                out.append((start, stop, p))
                end = stop
                free = slice(start, stop)
                period[free], until[free] = np.where(until[free] < stop, p, period[free]), np.maximum(until[free], stop)
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation of a value; 0 for an empty one.

    Segments: a ranked word (plain, in other case or with digits for letters), a date, a
    walk of 3 keys or more on a keyboard row or the alphabet, a unit of any length twice or
    more (3 characters at least), or one character by brute force. All but the last cost
    log10(2) more for their place; a walk or repeat one more for its length. Every start and
    end counts. A walk or repeat goes on at no cost, so the time is in proportion to the length
    and to the stretches that repeat.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a character that lower-cases to two
        low = value
    leet = low.translate(_LEET)
    rank_of, longest = ranks()
    brute = [_brute(c) for c in value]
    spent = [0.0, *accumulate(brute)]
    best = [0.0] + [math.inf] * n
    walking = math.inf  # the least cost of a walk of three keys or more that ends here
    starting: dict[int, list[list]] = {}
    for a, b, p in repetitions(value):
        starting.setdefault(a + 2 * p, []).append([p, b, [math.inf] * p])
    active: list[list] = []
    for j in range(n + 1):
        if j:
            best[j] = min(best[j], best[j - 1] + brute[j - 1])
        if j >= 3 and (low[j - 2], low[j - 1]) in _NEXT:
            if (low[j - 3], low[j - 2]) in _NEXT:
                walking = min(walking, best[j - 3] + _WALK + _LENGTH + _JOIN)
            best[j] = min(best[j], walking)
        else:
            walking = math.inf
        active += starting.get(j, ())
        for x in active:
            p, end, least = x
            if j <= end:
                if p > 1:
                    least[j % p] = min(least[j % p], best[j - 2 * p] + spent[j - p] - spent[j - 2 * p] + _LENGTH + _JOIN)
                elif j - 3 >= 0 and value[j - 3] == value[j - 1]:
                    least[0] = min(least[0], best[j - 3] + brute[j - 1] + _LENGTH + _JOIN)
                best[j] = min(best[j], least[j % p])
        active = [x for x in active if x[1] > j]
        at = best[j]
        for k in range(3, min(longest, n - j) + 1):
            plain, part = low[j : j + k], leet[j : j + k]
            if rank := rank_of.get(plain) or rank_of.get(part):
                cost = math.log10(rank + 1) + _JOIN * ((value[j : j + k] != plain) + (plain not in rank_of))
                best[j + k] = min(best[j + k], at + cost + _JOIN)
        for end in date_ends(value, j):
            best[end] = min(best[end], at + math.log10(365 * 120 if end - j > 4 else 120) + _JOIN)
    return best[n]


def value_end(text: str, start: int, least: int) -> int:
    """End of the whole value at start, least or later: up to white space or a quote, without punctuation after it unless quotes enclose it."""
    end = max(least, _VALUE.match(text, start).end())
    if start and text[start - 1] in "\"'`" and text[end : end + 1] == text[start - 1]:
        return end
    return max(least, start + len(text[start:end].rstrip(".,;:!?)]}")))


def find_spans(text: str, may=(True, True, True, True), min_log10: float = 8.0) -> tuple[list[tuple[int, int, int]], float]:
    """All (start, kind's number, end) in order, and the highest guess cost of a value in credential context."""
    found, highest = [], 0.0
    if may[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if may[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if may[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if may[0] or may[3]:
        values = {(m.start(2), value_end(text, m.start(2), m.end(2))) for m in ASSIGN.finditer(text) if len(m[2]) >= 6} if may[0] else set()
        if may[3]:
            for m in CONTEXT.finditer(text):
                a, b = m.start(1), value_end(text, m.start(1), m.start(1))
                over = {x for x in values if x[0] < b and a < x[1]}
                if b - a >= 6 and all(b - a > d - c for c, d in over):
                    values -= over
                    values.add((a, b))
        for a, b in values:
            cost = guess_cost(text[a:b])
            highest = max(highest, cost)
            if cost >= min_log10:
                found.append((a, 3, b))
    return sorted(found), highest


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mask."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    if end < 0:
        return text
    return "".join(out) + mask + text[end:]


def _scanned(min_log10: float):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()), ("max_log10_guesses", pa.float64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])
    keep = [f.name for f in schema if f.name != "row"]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in text_slices(batches, 1):
            ids, texts = batch.column(0), batch.column(1)
            may = [pc.fill_null(pc.match_substring_regex(texts, p), False).to_pylist() for p in (_MAY_ASSIGN, "AKIA", HEX.pattern.replace(",", ""), _MAY_CONTEXT)]
            rows = []
            for i, m in enumerate(zip(*may)):
                if not any(m):
                    rows.append((0, 0, 0, 0, 0.0, empty, "", None))
                    continue
                text = texts[i].as_py()
                spans, highest = find_spans(text, m, min_log10)
                n = [sum(k == x for _, k, _ in spans) for x in range(4)]
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
                every = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                rows.append((*n, highest, hashlib.sha256(base.encode()).hexdigest(), every, redact(text, spans) if spans else None))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, schema.field(k).type) for c, k in zip(columns, keep[1:]))], names=keep)

    return run


def secret_scan(docs: DataFrame, min_log10: float = 8.0) -> DataFrame:
    """One row per row of docs (doc_id, text): the counts of each kind, base_sha256, spans, and redacted.

    spans lists kind:start:end in code points, end exclusive, by start, then kind
    (assign, access, hex, guess). base_sha256 is of the same list without guess.
    redacted is the text with all spans masked, null if there are none. Null text
    equals empty text; rows repeat as often as in docs, null ids too; texts of any length
    are read whole; an empty table gives no rows; other columns are dropped.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scanned(min_log10), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, max_log10_guesses double, base_sha256 string, spans string, redacted string")


def _redacting(min_log10: float, at: int, n_chars: int | None):
    def run(batches):
        for batch in text_slices(batches, at):
            texts = batch.column(at)
            may = pc.fill_null(pc.or_(pc.match_substring_regex(texts, _MAY_ASSIGN), pc.or_(pc.match_substring_regex(texts, HEX.pattern.replace(",", "")), pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, _MAY_CONTEXT)))), False)
            if pc.any(may).as_py():
                new = []
                for x, m in zip(texts.to_pylist(), may.to_pylist()):
                    new.append(redact(x, find_spans(x, min_log10=min_log10)[0]) if m else x)
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.schema.field(at).type)
                if n_chars is not None:
                    sizes = pa.array([0 if x is None else len(x) for x in new], pa.int64()).cast(batch.schema.field(n_chars).type)
                    columns[n_chars] = pc.if_else(may, sizes, columns[n_chars])  # others keep what they had
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redact_secrets(docs: DataFrame, min_log10: float = 8.0) -> DataFrame:
    """docs with the secrets of the text column masked and n_chars, if there, made to fit; all rows and columns stay."""
    names = docs.columns
    return docs.mapInArrow(_redacting(min_log10, names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents")).drop("redacted")

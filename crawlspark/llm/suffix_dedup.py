"""Repeated passages by common-prefix interval trees over sparse enhanced suffix arrays.

Every window of `length` bytes has an anchor, the leftmost of its `gram`-byte strings
whose hash is least, so equal windows have equal anchors at equal offsets, wherever they
are. Occurrences of one anchor string are a group. A group's contexts (all bytes of the
windows that an occurrence anchors) are sorted by what follows the anchor; with the
longest common prefixes of neighbours that is an enhanced suffix array of the anchors'
suffixes. A stack scan gives its intervals: r bytes that all suffixes in one share, with
all occurrences. In each interval the contexts are sorted by what precedes the anchor,
backwards; where neighbours differ the repeat is left-diverse, and where they agree for l
bytes it extends to the left: windows that start at most l and at least length - r bytes
before the anchor occur twice. The intervals are the maximal repeats with all their
occurrences, so no pairs are formed.

Scale: a first pass counts anchor strings (8 bytes per 140 bytes of text) and keeps one
bit for those that occur twice, in a bitmap of fixed size. A second compares 128-bit
digests of their contexts, within a stretch of a task first, so that a context that a
third of all documents hold is one row a stretch, then across tasks, a context a key: a
context that occurs twice is a repeat as it is, and only the different contexts of an
anchor string that has several are needed as bytes, one occurrence of each. A second
bitmap tells a third pass which. A bit in common costs work
and never changes a result. Texts are shuffled once, at the end, to meet their spans. An
anchor string with more than `most` different contexts is split: windows that begin j to k
bytes before it agree in the bytes that all of them hold, so contexts that agree there are
a group for those windows, and groups are halved by j until they are small enough for one
suffix array, or are one window. What agrees in all windows of a half is settled in its
task, so a passage that a third of all documents hold goes on as one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load, shuffle_parts, text_slices, to_bytes

_BITS = 27
_NULL_ID = -(2**63)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of gram bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = 1
    while n < gram:
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        left = h[:-n] >> np.uint64(29)
        left ^= h[:-n]
        left *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        left += h[n:]
        h = left
        n *= 2
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    n = 1
    while 2 * n <= w:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - w + n], values[w - n :]) if w > n else values


def _runs(data: np.ndarray, length: int, gram: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, anchor, hash) of every run of windows of data with one anchor, a block of windows at a time, so that all is done in the cache."""
    w = length - gram + 1
    found = []
    for s in range(0, len(data) - length + 1, block):
        h = gram_hashes(data[s : s + block + length - 1], gram)
        at = (_least((h & _HIGH) | np.arange(len(h), dtype=np.uint64), w) & ~_HIGH).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at = at[first]
        found.append((first + s, at + s, h[at]))
    first, at, h = (np.concatenate(x) for x in zip(*found))
    new = np.diff(at, prepend=-1) != 0  # else a run goes on from the block before
    return first[new], at[new], h[new]


def anchors(texts: list[bytes], length: int, gram: int, block: int = 1 << 15):
    """(document, first start, last start, anchor, hash) of every run of windows with one anchor, and the joined texts.

    Positions are those in the joined texts. block bounds how many windows are looked at together, not what is found.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    docs = np.flatnonzero(sizes >= length)
    if not len(docs):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), data
    begin = (np.cumsum(sizes) - sizes)[docs]
    end = begin + sizes[docs] - length + 1
    runs, at, h = _runs(data, length, gram, block)
    # runs end where a document's windows do
    start = np.unique(np.concatenate([runs, begin, end]))
    of = np.searchsorted(begin, start, "right") - 1
    own = np.flatnonzero((of >= 0) & (start < end[of]))
    first, of = start[own], of[own]
    run = np.searchsorted(runs, first, "right") - 1
    return docs[of], first, start[own + 1] - 1, at[run], h[run], data


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]):
    """The common-prefix intervals (length, first, last) of an array; lcp[i] is of items i - 1 and i, lcp[0] unused."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeated_windows(contexts: list[tuple[bytes, int, bool]], length: int) -> list[list[tuple[int, int]]]:
    """For each different context (bytes, anchor's offset, occurs twice): ranges (first, last) of window starts that occur elsewhere, relative to the context."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for k, (c, _, twice) in enumerate(contexts):
        if twice:
            out[k].append((0, len(c) - length))
    if len(contexts) == 1:
        return out
    after = [c[at:] for c, at, _ in contexts]
    before = [c[:at][::-1] for c, at, _ in contexts]
    order = sorted(range(len(contexts)), key=after.__getitem__)
    lcp = [0] + [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    for r, first, last in intervals(lcp):
        if length - r > max(len(before[k]) for k in order[first : last + 1]):
            continue  # no window ends within r bytes
        members = sorted(order[first : last + 1], key=before.__getitem__)
        extends = [0] + [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:])] + [0]
        for k, m in enumerate(members):
            left = max(extends[k], extends[k + 1])
            c, at, twice = contexts[m]
            nearest = max(length - r, length - len(after[m]))
            if not twice and left >= nearest:
                out[m].append((at - left, at - nearest))
    return out


def _by_range(chunks, ranges: int, again: bool = False, most: int = 1 << 19):
    """Values of arrays by range, in batches (r, once, again): those met once and those met again; `again` takes all for met again."""

    def emit(parts):
        v, n = np.unique(np.concatenate(parts), return_counts=True)
        more = (n > 1) | again
        cuts = np.searchsorted(v, np.arange(1, ranges, dtype=np.uint64) * np.uint64(2**64 // ranges))
        rows = [(r, v[a:b][~more[a:b]].tobytes(), v[a:b][more[a:b]].tobytes()) for r, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["r", "once", "again"])

    parts, held = [], 0
    for x in chunks:
        parts.append(x)
        held += len(x)
        if held > most:
            yield emit(parts)
            parts, held = [], 0
    if held:
        yield emit(parts)


def _strings(length: int, gram: int, ranges: int):
    """Anchor strings of a task by range of their hashes."""

    def run(batches):
        yield from _by_range((anchors(to_bytes(b.column(0)), length, gram)[4] for b in text_slices(batches, 0, 2 << 20)), ranges)

    return run


def _flags(ranges: int):
    bits = (1 << _BITS) // ranges

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = [], []
        for batch in batches:
            for a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("once", "again"))):
                once.append(np.frombuffer(a, np.uint64))
                again.append(np.frombuffer(b, np.uint64))
        h, n = np.unique(np.concatenate(once + again + again), return_counts=True)
        flags = np.zeros(bits, bool)
        flags[(h[n > 1] >> np.uint64(64 - _BITS)).astype(np.int64) & (bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["r", "flags"])

    return run


def _bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - _BITS)
    return (bitmap[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _place_hash(doc_ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    h = (doc_ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rows.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + starts.view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _found(batches, length: int, gram: int):
    """The anchors of a task's documents by slice: (doc_ids, rows, starts in the document, first, last, anchor, hash, data)."""
    for batch in text_slices(batches, 2, 2 << 20):
        texts = to_bytes(batch.column(2))
        doc, first, last, at, h, data = anchors(texts, length, gram)
        ids, rows = (pa.compute.fill_null(batch.column(i), 0).to_numpy()[doc] for i in (0, 1))
        begins = np.cumsum([0] + [len(x) for x in texts])[doc]
        yield ids, rows, first - begins, first, last, at, h, data


_OCCURRENCES = "key long, kind int, h long, c1 long, c2 long, doc_id long, row long, start long, n long"
#: Kinds of occurrences: settled as a repeat; the only one of its context in its stretch; the first of several, all settled.
_SETTLED, _ONLY, _FIRST = 0, 1, 2


def _occurrences(length: int, gram: int, flags, most: int = 1 << 16):
    """Where the contexts of anchor strings that occur twice are, and their digests.

    Contexts that occur twice in a stretch of `most` occurrences of a task are settled there,
    so of a context that a third of all documents hold a row a stretch is left to compare.
    """

    def emit(parts):
        h, c1, c2, ids, rows, starts, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c2, c1, h))
        h, c1, c2, ids, rows, starts, n = (x[order] for x in (h, c1, c2, ids, rows, starts, n))
        new = np.append(True, (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        kind = np.concatenate([np.full(int(several.sum()), _SETTLED), np.where(several[new], _FIRST, _ONLY)]).astype(np.int32)
        out = [np.concatenate([x[several], x[new]]) for x in (h, c1, c2, ids, rows, starts, n)]
        key = np.where(kind == _SETTLED, _place_hash(*out[3:6]).view(np.int64), out[0] ^ out[1])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, kind, *out)], names=["key", "kind", "h", "c1", "c2", "doc_id", "row", "start", "n"])

    def run(batches):
        bitmap = np.frombuffer(flags.value, np.uint8)
        parts, held = [], 0
        for ids, rows, starts, first, last, at, h, data in _found(batches, length, gram):
            keep = np.flatnonzero(_bits(bitmap, h))
            blake = hashlib.blake2b
            digest = b"".join([blake(data[s:e], digest_size=16).digest() for s, e in zip(first[keep].tolist(), (last[keep] + length).tolist())])
            c = np.frombuffer(digest, np.int64).reshape(-1, 2)
            parts.append((h[keep].view(np.int64), c[:, 0], c[:, 1], ids[keep], rows[keep], starts[keep], (last - first)[keep]))
            held += len(keep)
            if held >= most:
                yield emit(parts)
                parts, held = [], 0
        if held:
            yield emit(parts)

    return run


_JUDGED = "h long, doc_id long, row long, from long, to long"


def _judged(length: int):
    """Of rows sorted by (h, c1, c2): spans of contexts that occur twice, and one place of each context (to = -1)."""

    def batch_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "doc_id", "row", "from", "to"])

    def emit(t):
        kind, h, c1, c2, doc_id, row, start, n = t
        new = np.append(True, (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
        c_of = np.cumsum(new) - 1
        twice = (np.bincount(c_of)[c_of] > 1) & (kind == _ONLY)
        return batch_of(*(np.concatenate([x[twice], y[new]]) for x, y in ((h, h), (doc_id, doc_id), (row, row), (start, start), (start + n + length, np.full(len(start), -1)))))

    def run(batches):
        held = None
        for batch in batches:
            t = [c.to_numpy() for c in batch.columns]
            done = t[0] == _SETTLED
            if done.any():
                h, _, _, doc_id, row, start, n = (x[done] for x in t[1:])
                yield batch_of(h, doc_id, row, start, start + n + length)
                t = [x[~done] for x in t]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held, t)]
            last = [x[-1:] for x in t[1:4]]
            # the last context may go on
            same = np.flatnonzero((t[1] != last[0]) | (t[2] != last[1]) | (t[3] != last[2])) if len(t[0]) else np.zeros(0, int)
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield emit([x[:cut] for x in t])
            held = [x[cut:] for x in t]
        if held is not None and len(held[0]):
            yield emit(held)

    return run


def _anchor_hashes(ranges: int):
    """Anchor strings of contexts by range of their hashes."""

    def run(batches):
        yield from _by_range((b.column(0).to_numpy().view(np.uint64) for b in batches), ranges)

    return run


def _needed(ranges: int, several):
    """Places of contexts whose anchor string has several, by range of their hashes."""

    def run(batches):
        bitmap = np.frombuffer(several.value, np.uint8)

        def places():
            for batch in batches:
                h, *place = (batch.column(i).to_numpy() for i in range(4))
                yield _place_hash(*place)[_bits(bitmap, h.view(np.uint64))]

        yield from _by_range(places(), ranges, again=True)

    return run


_CONTEXTS = "h long, at int, context binary, doc_id long, row long, start long"


def _contexts(length: int, gram: int, flags):
    """The bytes of the contexts at needed places."""

    def run(batches):
        bitmap = np.frombuffer(flags.value, np.uint8)
        for ids, rows, starts, first, last, at, h, data in _found(batches, length, gram):
            k = np.flatnonzero(_bits(bitmap, _place_hash(ids, rows, starts)))
            for i in range(0, len(k), 4096):
                part = k[i : i + 4096]
                context = [data[s:e].tobytes() for s, e in zip(first[part].tolist(), (last[part] + length).tolist())]
                columns = [pa.array(h[part].view(np.int64)), pa.array((at - first)[part].astype(np.int32)), pa.array(context, pa.binary()), *(pa.array(x[part]) for x in (ids, rows, starts))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "at", "context", "doc_id", "row", "start"])

    return run


def _spans(length: int):
    """Spans (doc_id, row, from, to) that repeat, of rows sorted by h."""

    def solve(group: dict[bytes, list]):
        contexts = [(c, at, len(v) > 1) for c, (at, v) in group.items()]
        for (_, v), ranges in zip(group.values(), repeated_windows(contexts, length)):
            for a, b in _merged(ranges):
                for doc_id, row, start in v:
                    yield doc_id, row, start + a, start + b + length

    def run(batches):
        h, group, out = None, {}, []
        for batch in batches:
            for x, at, context, *where in zip(*(c.to_pylist() for c in batch.columns)):
                if x != h:
                    if group and (len(group) > 1 or len(next(iter(group.values()))[1]) > 1):
                        out += solve(group)
                    h, group = x, {}
                group.setdefault(context, (at, []))[1].append(tuple(where))
            if out:
                yield _span_batch(out)
                out = []
        if group:
            out += solve(group)
        if out:
            yield _span_batch(out)

    return run


_HALVES = "kind int, h long, leaf boolean, j1 int, j2 int, at int, context binary, doc_id long, row long, start long, to long"


def _halves(length: int, most: int = 1 << 14):
    """Contexts (h, j1, j2, at, context, doc_id, row, start) of large groups, each in two groups: for the lower and the upper half of
    j, the contexts that agree in what all windows that begin so far before the anchor share.

    Contexts of a stretch of a task that agree in all their windows of a half are settled there
    (kind _SETTLED, from start to `to`), but for one that goes on and stands for them (_ONLY).
    """
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def emit(rows):
        groups: dict[tuple, list] = {}
        for h, j1, j2, at, context, *place in rows:
            middle = (j1 + j2) // 2
            for a, b in ((j1, middle), (middle + 1, j2)):
                lo, hi = max(a, at + length - len(context)), min(b, at)  # the windows of the half that the context has
                if lo <= hi:
                    core = hashlib.blake2b(context[at - a : at + length - b], digest_size=8, key=f"{h} {a} {b}".encode()).digest()
                    groups.setdefault((core, a, b, lo, hi, context[at - hi : at + length - lo]), []).append((at, context, *place))
        out = []
        for (core, a, b, lo, hi, _), members in groups.items():
            if len(members) > 1:
                out += [(_SETTLED, None, None, None, None, None, None, doc_id, row, start + at - hi, start + at - lo + length) for at, _, doc_id, row, start in members]
            out.append((_ONLY, int.from_bytes(core, "little", signed=True), a == b, a, b, *members[0], None))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in _HALVES.split(", ")])

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                if len(rows) >= most:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    return run


def _span_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "row", "from", "to"])


def _merged(ranges):
    """Sorted ranges, those that overlap or touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _large(rows: DataFrame, work: Workspace, name: str, most: int) -> tuple[DataFrame, bool]:
    """(g): groups h of more than `most` rows, and whether they are few enough to broadcast (8 bytes each)."""
    large = work.save(rows.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"), name)
    return large, large.limit(1_000_001).count() <= 1_000_000


def _among(rows: DataFrame, large: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(large) if few else large, F.col("h") == F.col("g"), how)


def _solved(contexts: DataFrame, work: Workspace, length: int, gram: int, parts: int, most: int) -> list[DataFrame]:
    """Spans (doc_id, row, from, to) of contexts (h, at, context, doc_id, row, start), a group h a task if it has `most` at most.

    Larger groups are split by what lies around the anchor, until groups are small or of one window.
    """
    spans = "doc_id long, row long, from long, to long"
    columns = ["h", "at", "context", "doc_id", "row", "start"]

    def in_groups(rows: DataFrame, name: str) -> DataFrame:
        sorted_rows = rows.select(*columns).repartition(2 * parts, "h").sortWithinPartitions("h")
        return work.save(sorted_rows.mapInArrow(_spans(length), spans), name)

    large, few = _large(contexts, work, "large", most)
    out = [in_groups(_among(contexts, large, few, "left_anti"), "spans")]
    left = _among(contexts, large, few, "left_semi").withColumns({"j1": F.lit(0), "j2": F.lit(length - gram)})
    number = 0
    while not large.isEmpty():
        number += 1
        halves = work.save(left.repartition(2 * parts).select("h", "j1", "j2", *columns[1:]).mapInArrow(_halves(length), _HALVES), f"halves{number}")
        out.append(halves.where(F.col("kind") == _SETTLED).select("doc_id", "row", F.col("start").alias("from"), "to"))
        kids = halves.where(F.col("kind") == _ONLY)
        large, few = _large(kids.where("not leaf"), work, f"large{number}", most)
        out.append(in_groups(_among(kids, large, few, "left_anti"), f"spans{number}"))
        left = _among(kids, large, few, "left_semi")
    return out


def repeated_spans(docs: DataFrame, work: Workspace, length: int = 400, gram: int = 128, ranges: int = 64, most: int = 1000) -> DataFrame:
    """(doc_id, row, from, to): byte spans of docs (doc_id, row, text) whose every byte is in a window of `length` bytes that also starts elsewhere."""
    strings = docs.select("text").mapInArrow(_strings(length, gram, ranges), "r int, once binary, again binary")

    def bitmap(rows: DataFrame):
        """16 MB, whatever the input."""
        got = dict(rows.groupBy("r").applyInArrow(_flags(ranges), "r int, flags binary").collect())
        empty = bytes((1 << _BITS) // ranges // 8)
        return docs.sparkSession.sparkContext.broadcast(b"".join(bytes(got.get(r, empty)) for r in range(ranges)))

    flags = bitmap(strings)
    parts = shuffle_parts(docs.sparkSession)
    places = docs.mapInArrow(_occurrences(length, gram, flags), _OCCURRENCES).repartition(parts, "key").drop("key").sortWithinPartitions("h", "c1", "c2")
    judged = work.save(places.mapInArrow(_judged(length), _JUDGED), "judged")
    by_range = "r int, once binary, again binary"
    several = bitmap(judged.where("to < 0").select("h").mapInArrow(_anchor_hashes(ranges), by_range))
    needed = judged.where("to < 0").select("h", "doc_id", "row", "from").mapInArrow(_needed(ranges, several), by_range)
    wanted = bitmap(needed)
    contexts = work.save(docs.mapInArrow(_contexts(length, gram, wanted), _CONTEXTS), "contexts")
    out = judged.where("to >= 0").drop("h")
    for more in _solved(contexts, work, length, gram, parts, most):
        out = out.unionByName(more)
    return out


def _cut(kept: str | None):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + {None: [], "bytes": ["kept"], "text": ["kept_text"]}[kept]

    def run(batches):
        for batch in text_slices(batches, 1):
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), batch.column(2).to_pylist()):
                merged = _merged((x["from"], x["to"]) for x in spans or ())
                left, at = [], 0
                for a, b in merged:
                    left.append(text[at:a])
                    at = b
                left = b"".join([*left, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest()) + {None: (), "bytes": (left,), "text": (left.decode("utf-8", "replace"),)}[kept])
            types = [pa.int64()] * 4 + [pa.string(), pa.binary() if kept == "bytes" else pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 128, kept: str | None = None, most: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text).

    kept="bytes" adds the remaining bytes (kept), kept="text" adds them as text (kept_text), in
    which a character that was cut through is U+FFFD.

    Texts are UTF-8 bytes, null is empty; matches never cross rows. A byte goes if a window
    of `length` bytes around it starts anywhere else, too, in the same text or another.
    Rows that repeat lose everything if they have `length` bytes. Null ids are kept; an
    empty table gives no rows; a text of any length is treated alike. Other columns are
    dropped. gram must be a power of two and at most length. most bounds the contexts that
    one enhanced suffix array holds, not what is found.
    """
    work = Workspace(docs.sparkSession, "suffix-dedup")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    spans = repeated_spans(docs, work, length, gram, most=most)
    found = spans.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = docs.join(found, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")), "left").select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_cut(kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {None: "", "bytes": ", kept binary", "text": ", kept_text string"}[kept])


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), kept="text")

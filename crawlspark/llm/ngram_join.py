"""N-gram Jaccard join by prefix trees, and the components of its links.

A document is its set of distinct word n-grams, as 64-bit hashes in one global order:
first hashes below LOW that few documents have, then such hashes above, then frequent
ones. Documents whose sets are equal are one class. Two classes with a Jaccard of at
least num/den share one of the first n - ceil(n num / den) + 1 hashes of each, so
classes meet at such hashes (those that other documents have, too). Links are found by
walks through prefix trees: sets as hash sequences, sorted, with the length that each
shares with the one before. An overlap found on a shared path is not counted again, and a
subtree is left as soon as what remains of a sequence cannot reach the overlap needed.

1. The least class at each hash is the pivot; its set walks through the trees of those
   that meet it.
2. Links found make components. Classes that share a hash but are in different components
   yet are a family. The first hashes of its classes, those that others have, in order are
   one tree, cut into subtrees of bounded size. In each, every class walks through those
   of other components, with the rest of its set as a bound on what may follow, and the
   closest that it cannot tell apart is verified.
3. At each hash where classes of several components still meet, those outside the hash's
   largest component walk through the tree of all that have it, and all that they cannot
   tell apart is verified. What is inside needs no further link among itself. Hashes that
   the same classes have are one. Where many classes meet, they are dealt by length and in
   blocks, so that a tree and what walks through it are of bounded size.

Verifying is a walk of one whole set through the tree of its partners' whole sets. Parity
sketches, whose Hamming distance is a lower bound of two sets' symmetric difference, say
which leaves of a tree a walk may pass over.

Scale: what is broadcast is a bitmap of fixed size (hashes that two documents have) and
up to two million frequent hashes; both only choose work. Copies collapse per task and
per hash, large groups get a linear number of pivot pairs and of closest pairs, a family's
subtrees (first hashes and sketches, a fifth of the sets) are dealt over tasks, and the last
step's work is that of classes outside a component and what they meet at a hash. Hashes of
a passage that many documents hold are frequent and come last, so classes meet there only
if such hashes are nearly all they have. Texts are read again instead of keeping all sets.

Classes and n-grams are compared by 64-bit hashes of a keyed function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load, shuffle_parts, text_slices, views
from .components import connected_components

#: Bits of the sketches within a tree.
TREE_BITS = 2048
LOW = np.uint64(0.3 * 2.0**64)
_BITS = 27
_SLICE = 2 << 20
_LONG_WORD = 512  # bytes of a word that are hashed by columns
_NULL_ID = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, eight bytes of all of them at a time; long ones are hashed one by one."""
    _, offsets, data = words.buffers()
    kind = np.dtype(np.int64 if pa.types.is_large_string(words.type) else np.int32)
    ends = np.frombuffer(offsets, kind, len(words) + 1, words.offset * kind.itemsize).astype(np.int64)
    start, size = ends[:-1], np.diff(ends)
    raw = (data.to_pybytes() if data is not None else b"") + bytes(8)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    h = _mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    for at in range(0, _LONG_WORD, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        beyond = np.maximum(8 - (size[left] - at), 0).astype(np.uint64) * np.uint64(8)
        part = eight[start[left] + at] << beyond  # without the bytes that follow the word
        h[left] = _mix((h[left] ^ part) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at + 1))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[ends[i] : ends[i + 1]], digest_size=8).digest(), "little")
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    """np.unique, which goes by a hash table, costs several times as much."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; fewer words are one n-gram, no words none."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat = pc.list_flatten(words)
    h = word_hashes(flat)
    offsets = (words.offsets.to_numpy() - words.offsets[0].as_py()).tolist()
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(grams) + i]
    grams = _mix(grams)
    out = []
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= n:
            out.append(_distinct(grams[a : b - n + 1]))
        elif b - a == 0 or b - a == 1 and flat[a].as_py() == "":
            out.append(np.zeros(0, np.uint64))
        else:
            out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their low bits, about two bits a hash and TREE_BITS at least, as bytes."""
    bits = TREE_BITS
    while bits < 2 * len(s) and bits < 1 << 20:
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def tree_sketch(k: np.ndarray) -> np.ndarray:
    """A sketch folded to TREE_BITS, which lowers distances if anything."""
    while len(k) > TREE_BITS // 8:
        k = k[: len(k) // 2] ^ k[len(k) // 2 :]
    return k.view(np.uint64)


class PrefixTree:
    """Hash sequences in one order, sorted, with the length that each shares with the one before.

    They are whole sets, or the beginnings of sets of n hashes of which `rest` may follow;
    then a walk finds all that cannot be told apart, a superset of the links.
    """

    def __init__(self, sequences: list[np.ndarray], n=None, rest=None, sketches=None):
        keys = [s.astype(">u8").tobytes() for s in sequences]
        self.order = sorted(range(len(sequences)), key=keys.__getitem__)
        self.sequences = [sequences[i] for i in self.order]
        self.n = np.array([len(s) for s in sequences] if n is None else n, np.int64)[self.order]
        self.rest = (np.zeros(len(sequences), np.int64) if rest is None else np.asarray(rest, np.int64))[self.order]
        rows = [tree_sketch(sketch(s)) for s in sequences] if sketches is None else sketches
        self.sketches = np.stack([rows[i] for i in self.order]) if len(sequences) else np.zeros((0, TREE_BITS // 64), np.uint64)
        self.shared = np.zeros(len(sequences), np.int64)
        for k in range(1, len(sequences)):
            a, b = self.sequences[k - 1], self.sequences[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(differ[0]) if len(differ) else m

    def walk(self, probe: np.ndarray, num: int, den: int, n: int | None = None, rest: int = 0, own_sketch=None, may=True, step: int = 64) -> list[tuple[int, int]]:
        """(sketch distance, number) of the sets that may have a Jaccard of num/den with the probe; of whole sets, those that have.

        may: a mask in the tree's order of leaves to look at.
        """
        size, n = len(probe), len(probe) if n is None else n
        apart = np.bitwise_count(self.sketches ^ (tree_sketch(sketch(probe)) if own_sketch is None else own_sketch)).sum(axis=1, dtype=np.int64)
        ok = may & (den * np.minimum(self.n, n) >= num * np.maximum(self.n, n)) & (apart * (num + den) <= (self.n + n) * (den - num))
        needs = -(-num * (self.n + n) // (num + den)) - np.maximum(self.rest, rest)  # of the overlap of the sequences
        depths, overlaps = [0], [0]  # known on the current path
        cut, cut_at = -1, (0, 0)  # depth at which the path was given up, and for which length and need; or -1
        before, out = -1, []
        for k in np.flatnonzero(ok).tolist():
            s = self.sequences[k]
            m, need = len(s), int(needs[k])
            shared = int(self.shared[before + 1 : k + 1].min()) if before >= 0 else 0
            before = k
            while depths[-1] > shared:
                depths.pop()
                overlaps.pop()
            if 0 <= cut <= shared and m <= cut_at[0] and need >= cut_at[1]:
                cut = min(cut, shared)
                continue  # below a node that was given up for a longer sequence or a lesser need
            cut = -1
            d, o = depths[-1], overlaps[-1]
            at = int(np.searchsorted(probe, s[d])) if d < m else size
            while d < m:
                if o + min(m - d, size - at) < need:
                    cut, cut_at = d, (m, need)
                    break
                end = min(m, d + step)
                part = s[d:end]
                where = np.searchsorted(probe, part)
                o += int((probe[np.minimum(where, size - 1)] == part).sum())
                d = end
                at = int(where[-1])
                depths.append(d)
                overlaps.append(o)
            else:
                if o >= need:
                    out.append((int(apart[k]), self.order[k]))
        return out

    def matches(self, probe: np.ndarray, num: int, den: int) -> list[int]:
        """Numbers of the whole sets whose Jaccard with the probe is num/den at least."""
        return [i for _, i in self.walk(probe, num, den)]


def _classes(n: int):
    def run(batches):
        for batch in text_slices(batches, 1, _SLICE):
            sets = shingle_sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets]), pa.array([signature(s) for s in sets]), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "sig", "sketch"])

    return run


def _fresh(batches, n: int):
    """The sets of a task's different documents, by slice."""
    seen: set[int] = set()
    for batch in text_slices(batches, 0, _SLICE):
        out = []
        for s in shingle_sets(batch.column(0), n):
            if len(s):
                sig = signature(s)
                if sig not in seen:
                    seen.add(sig)
                    out.append((sig, s))
        yield out


def _low(s: np.ndarray) -> np.ndarray:
    return s[: np.searchsorted(s, LOW)]


def _among(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which hashes of s are among the frequent ones, which are sorted."""
    if not len(frequent):
        return np.zeros(len(s), bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def _high(num: int, den: int, often):
    """What picks the hashes above of a set whose first hashes reach them."""

    def pick(s):
        low = _low(s)
        p = len(s) - -(-num * len(s) // den) + 1
        reaches = len(low) - int(_among(low, np.frombuffer(often.value, np.uint64)).sum()) < p
        return s[len(low) :] if reaches else s[:0]

    return pick


def _width(ranges: int, base: np.uint64) -> np.uint64:
    """How wide each range of the hashes below LOW (base 0) or from there on is."""
    return np.uint64((int(LOW) if base == 0 else 2**64 - int(base)) // ranges + 1)


def _counted(n: int, ranges: int, pick, base: np.uint64 = np.uint64(0)):
    """Per task and range of the hashes that pick takes of each set: those met once, and those met more often with their counts."""
    inner = base + _width(ranges, base) * np.arange(1, ranges, dtype=np.uint64)

    def emit(parts):
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        ends = [*np.searchsorted(tokens, inner).tolist(), len(tokens)]
        rows = []
        for r, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                many = counts[a:b] > 1
                rows.append((r, tokens[a:b][~many].tobytes(), tokens[a:b][many].tobytes(), counts[a:b][many].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["r", "once", "many", "counts"])

    def run(batches):
        parts, held = [], 0
        for sets in _fresh(batches, n):
            for _, s in sets:
                picked = pick(s)
                if len(picked):
                    parts.append(picked)
                    held += len(picked)
            if held > 1 << 20:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _frequencies(ranges: int, keep: int, least: int, base: np.uint64 = np.uint64(0)):
    """Per range: its most frequent hashes and, below LOW, the bits of hashes that two documents have."""
    width = _width(ranges, base)
    bits = (1 << _BITS) // ranges
    step = width // np.uint64(bits) + np.uint64(1)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = key[0].as_py()
        tokens, counts = [], []
        for batch in batches:
            for once, many, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("once", "many", "counts"))):
                tokens += [np.frombuffer(once, np.uint64), np.frombuffer(many, np.uint64)]
                counts += [np.ones(len(tokens[-2]), np.uint32), np.frombuffer(n, np.uint32)]
        t, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        flags = np.zeros(bits if base == 0 else 0, bool)
        if base == 0:
            flags[((t[c > 1] - np.uint64(r) * width) // step).astype(np.int64)] = True
        often = np.flatnonzero(c > least)
        often = often[np.argsort(-c[often], kind="stable")][:keep]
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([t[often].tobytes()], pa.binary())], names=["r", "flags", "often"])

    return run


def _prefixes(n: int, num: int, den: int, ranges: int, flags, often, groups: int):
    width = _width(ranges, np.uint64(0))
    bits = (1 << _BITS) // ranges
    step = width // np.uint64(bits) + np.uint64(1)

    def emit(parts):
        token, sig, size = (np.concatenate(x) for x in zip(*parts))
        g = (_mix(token) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(g, kind="stable")
        token, sig, size, g = token[order], sig[order], size[order], g[order]
        cuts = np.flatnonzero(np.diff(g, prepend=-1)).tolist()
        rows = [(int(g[a]), token[a:b].tobytes(), sig[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(g)])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["g", "token", "sig", "size"])

    def run(batches):
        bitmap, frequent = np.frombuffer(flags.value, np.uint8), np.frombuffer(often.value, np.uint64)
        parts, held = [], 0
        for sets in _fresh(batches, n):
            for sig, s in sets:
                p = len(s) - -(-num * len(s) // den) + 1
                low = _low(s)
                high = s[len(low) :]
                late = _among(low, frequent)
                low, last = low[~late][:p], low[late]
                r = low // width
                bit = r * np.uint64(bits) + (low - r * width) // step
                low_shared = low[(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                tokens = low_shared
                if len(low) < p:
                    late = _among(high, frequent)
                    tokens = np.concatenate([low_shared, np.concatenate([high[~late], last, high[late]])[: p - len(low)]])
                if len(tokens):
                    parts.append((tokens, np.full(len(tokens), sig, np.int64), np.full(len(tokens), len(s), np.int32)))
                    held += len(tokens)
            if held > 1 << 19:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _meetings():
    """Rows (token, sig, n, pivot, pivot_n) of the hashes at which two classes meet."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], [], []]
        for batch in batches:
            for out, c, t in zip(parts, ("token", "sig", "size"), (np.uint64, np.int64, np.int32)):
                out += [np.frombuffer(x, t) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()]
        token, sig, size = (np.concatenate(x) for x in parts)
        order = np.lexsort((sig, token))
        token, sig, size = token[order], sig[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])  # copies in other tasks
        token, sig, size = token[new], sig[new], size[new]
        start = np.flatnonzero(np.diff(token, prepend=token[:1] ^ np.uint64(1)))
        count = np.diff(np.append(start, len(token)))
        first = np.repeat(start, count)
        keep = np.repeat(count > 1, count)
        for a in range(0, int(keep.sum()), 1 << 17):
            at = np.flatnonzero(keep)[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64)), pa.array(sig[at]), pa.array(size[at]), pa.array(sig[first[at]]), pa.array(size[first[at]])], names=["token", "sig", "n", "pivot", "pivot_n"])

    return run


def _near(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (na, nb, a, b) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "ka", "kb")))):
                if den * min(na, nb) >= num * max(na, nb) and sketch_distance(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) * (num + den) <= (na + nb) * (den - num):
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def _sets(n: int):
    def run(batches):
        for batch in text_slices(batches, 0, _SLICE):
            sets = shingle_sets(batch.column(0), n)
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "hashes"])

    return run


def _heads(batches):
    """(sig, n, head, order, sketch): the first hashes of each class, which come as arrays, in order and cut to their upper halves (equal ones stay equal), what sorts them, and the sketch of a tree."""
    for batch in batches:
        heads = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in batch.column(2).to_pylist()]
        sketches = [tree_sketch(np.frombuffer(x, np.uint8)).tobytes() for x in views(batch.column(3))]
        columns = [pa.array(x, pa.binary()) for x in ([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in heads], [x[:8].astype(">u8").tobytes() for x in heads], sketches)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["sig", "n", "head", "order", "sketch"])


def _rest(n, num: int, den: int):
    return -(-n * num // den) - 1  # n - (n - ceil(n num / den) + 1) hashes follow the first ones


def _closest(num: int, den: int, most: int):
    """Pairs (a, b), a < b, of classes with the nearest of another component in their subtree.

    Rows (lo, sig, root, n, head, sketch) come in order of family and hashes; a subtree has at most `most` classes.
    """

    def pairs(rows):
        sigs, roots, n, heads, sketches = zip(*rows)
        if len(set(roots)) == 1:
            return set()
        heads, sketches = [np.frombuffer(x, np.uint32) for x in heads], [np.frombuffer(x, np.uint64) for x in sketches]
        rest = [_rest(x, num, den) for x in n]
        tree = PrefixTree(heads, n, rest, sketches)
        at, found = np.array(roots, np.int64)[tree.order], set()
        for i, sig in enumerate(sigs):
            if near := tree.walk(heads[i], num, den, n[i], rest[i], sketches[i], at != roots[i]):
                j = min(near)[1]
                found.add((min(sig, sigs[j]), max(sig, sigs[j])))
        return found

    def run(batches):
        family, rows = None, []
        for batch in batches:
            found = set()
            for lo, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (lo != family or len(rows) >= most):
                    found |= pairs(rows)
                    rows = []
                family = lo
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if rows and (found := pairs(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def _met_at_hash(num: int, den: int):
    """Pairs (a, b), a < b, of classes of different components that one block's trees cannot tell apart.

    Rows (sig, root, n, head, sketch, probe, and the block's key) come by block, those of the
    tree first, then those that walk through it.
    """

    def run(batches):
        key, tree, sigs, at, members = None, None, [], None, []
        for batch in batches:
            found = set()
            for sig, root, n, head, words, probe, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    key, tree, members = block, None, []
                row = (sig, root, n, np.frombuffer(head, np.uint32), np.frombuffer(words, np.uint64))
                if not probe:
                    members.append(row)
                    continue
                if tree is None and members:
                    sigs, roots, sizes, heads, sketches = zip(*members)
                    tree = PrefixTree(list(heads), sizes, [_rest(x, num, den) for x in sizes], list(sketches))
                    at, members = np.array(roots, np.int64)[tree.order], []
                if tree is not None:
                    for _, j in tree.walk(row[3], num, den, n, _rest(n, num, den), row[4], at != root):
                        found.add((min(sig, sigs[j]), max(sig, sigs[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def _linked(num: int, den: int):
    """Links of each (a, chunk), whose rows come with the set of a first."""

    def links(a, probe, members):
        if probe is None or not members:
            return []
        tree = PrefixTree([np.frombuffer(x, np.uint64) for _, x in members])
        return [(a, members[i][0]) for i in tree.matches(probe, num, den)]

    def run(batches):
        key, probe, members = None, None, []
        for batch in batches:
            found = []
            for a, chunk, b, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), views(batch.column(3))):
                if (a, chunk) != key:
                    if key:
                        found += links(key[0], probe, members)
                    key, probe, members = (a, chunk), None, []
                if b is None:
                    probe = np.frombuffer(hashes, np.uint64)
                else:
                    members.append((b, hashes))
            # what the next batch goes on with must not hold this one
            probe, members = None if probe is None else probe.copy(), [(b, bytes(x)) for b, x in members]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if key and (found := links(key[0], probe, members)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, work: Workspace, broadcast_docs: int, chunk: int, tree: int):
        self.docs, self.n, self.num, self.den, self.work, self.broadcast_docs, self.chunk, self.tree = docs, n, num, den, work, broadcast_docs, chunk, tree
        self.parts = shuffle_parts(docs.sparkSession)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are links: the set of each a walks through the prefix trees of its partners."""
        work = self.work
        near = work.save(pairs, f"{name}-near")
        sizes = near.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("partners"))
        chunked = near.join(work.save(sizes, f"{name}-sizes"), F.col("a") == F.col("x")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / self.chunk)).alias("chunk"))
        chunked = work.save(chunked, f"{name}-chunked")
        involved = chunked.select(F.col("a").alias("sig")).union(chunked.select(F.col("b").alias("sig"))).distinct()
        wanted = work.save(self.classes.join(involved, "sig", "left_semi").select(F.col("rep").alias("wanted")).distinct(), f"{name}-wanted")
        small = wanted.limit(self.broadcast_docs + 1).count() <= self.broadcast_docs  # 8 bytes each
        texts = self.docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("wanted"), "left_semi").select("text")
        sets = work.save(texts.mapInArrow(_sets(self.n), "sig long, hashes binary").join(involved.hint("shuffle_hash"), "sig", "left_semi").dropDuplicates(["sig"]), f"{name}-sets")
        members = chunked.join(sets, F.col("b") == F.col("sig")).select("a", "chunk", "b", "hashes")
        probes = chunked.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("sig")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "hashes")
        rows = members.unionByName(probes).repartition(self.parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        links = work.save(rows.mapInArrow(_linked(self.num, self.den), "a long, b long"), f"{name}-links")
        work.drop(*(f"{name}-{x}" for x in ("near", "sizes", "chunked", "wanted", "sets")))
        return links

    def families(self, met: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(lo, sig, root): classes that share a hash with other components, whose least root is lo; (sig, n, head, order, sketch) of those; and (token, sig, n) where they meet."""
        work = self.work
        placed = work.save(met.select("token", "sig", "n").join(roots, F.col("sig") == F.col("node"), "left").select("token", "sig", "n", F.coalesce("root", "sig").alias("root")), "placed")
        work.drop("met")
        mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("token").alias("t"), "lo")
        mixed = work.save(placed.join(mixed, F.col("token") == F.col("t")).select("token", "sig", "n", "lo", "root"), "mixed")
        family = work.save(mixed.select("lo", "sig", "root").distinct(), "family")
        some = family.select(F.col("sig").alias("s")).distinct()
        heads = placed.join(some, F.col("sig") == F.col("s"), "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.collect_list("token").alias("head"))
        heads = heads.join(self.classes.select(F.col("sig").alias("s"), "sketch"), F.col("sig") == F.col("s")).select("sig", "n", "head", "sketch")
        heads = work.save(heads.mapInArrow(_heads, "sig long, n int, head binary, order binary, sketch binary"), "heads")
        work.drop("placed")
        return family, heads, mixed.select("token", "sig", "n")

    def closest(self, family: DataFrame, heads: DataFrame) -> DataFrame:
        """Pairs of each class with the nearest of another component in its subtree of the family."""
        rows = family.join(heads, "sig").repartitionByRange(self.parts, "lo", "order", "sig").sortWithinPartitions("lo", "order", "sig")
        return rows.select("lo", "sig", "root", "n", "head", "sketch").mapInArrow(_closest(self.num, self.den, self.tree), "a long, b long").distinct()

    def outside(self, mixed: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs that may link of classes outside the largest component at a hash with those of other components there."""
        work, most = self.work, 4 * self.tree
        now = work.save(mixed.join(roots, F.col("sig") == F.col("node"), "left").select("token", "sig", "n", F.coalesce("root", "sig").alias("root")), "mixed-now")
        work.drop("mixed")
        of_root = now.groupBy("token", "root").agg(F.count("*").alias("c"), *(F.bit_xor(F.xxhash64("sig", F.lit(i))).alias(f"x{i}") for i in (0, 1)))
        of_hash = of_root.groupBy("token").agg(F.sum("c").alias("met"), F.max_by("root", F.struct("c", "root")).alias("held"), F.count("*").alias("components"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (0, 1)))
        # hashes that the same classes have (a shared passage) are one
        hashes = work.save(of_hash.where("components > 1").groupBy("met", "held", "x0", "x1").agg(F.min("token").alias("t")).select("t", "met", "held"), "hashes")
        band = F.when(F.col("met") > most, F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.001 * max(self.den / self.num, 1.05))))).otherwise(0)
        rows = work.save(now.join(hashes, F.col("token") == F.col("t")).select("token", "sig", "n", "root", (F.col("met") > most).alias("hot"), (F.col("root") != F.col("held")).alias("out"), band.alias("band")), "meeting")
        sizes = rows.groupBy("token", "band").agg(F.count("*").alias("held"), F.count_if("out").alias("asking"))
        sizes = sizes.select(F.col("token").alias("t"), F.col("band").alias("to"), *(F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("held", "asking")))
        # a band's classes, and those from outside of it and the bands beside it, in blocks
        near = F.when(F.col("hot"), F.sequence(F.col("band") - 1, F.col("band") + 1)).otherwise(F.array("band"))
        asks = rows.where("out").withColumn("to_band", F.explode(near))
        around = sizes.select(F.col("t").alias("t2"), F.explode(F.sequence(F.col("to") - 1, F.col("to") + 1)).alias("to2"), "asking").groupBy("t2", "to2").agg(F.sum("asking").cast("int").alias("asking"))
        blocks = work.save(sizes.drop("asking").join(around, (F.col("t") == F.col("t2")) & (F.col("to") == F.col("to2"))).where("asking > 0").select("t", "to", "held", "asking"), "blocks")
        in_block = lambda c: F.pmod(F.xxhash64("sig"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = rows.join(blocks, (F.col("token") == F.col("t")) & (F.col("band") == F.col("to"))).select("sig", "root", F.lit(False).alias("probe"), "token", "to", in_block("held").alias("i"), every("asking").alias("j"))
        asks = asks.join(blocks, (F.col("token") == F.col("t")) & (F.col("to_band") == F.col("to"))).select("sig", "root", F.lit(True).alias("probe"), "token", "to", every("held").alias("i"), in_block("asking").alias("j"))
        key = ["token", "to", "i", "j"]
        met = held.unionByName(asks).join(heads.select("sig", "n", "head", "sketch"), "sig").repartition(self.parts, *key).sortWithinPartitions(*key, "probe")
        return met.select("sig", "root", "n", "head", "sketch", "probe", *key).mapInArrow(_met_at_hash(self.num, self.den), "a long, b long").distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The documents (doc_id, n, sig) and the roots (node, root) of linked classes."""
        spark, work, n, num, den = self.docs.sparkSession, self.work, self.n, self.num, self.den
        docs = work.save(self.docs.mapInArrow(_classes(n), "doc_id long, n long, sig long, sketch binary"), "docs")
        self.classes = work.save(docs.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sketch").alias("sketch")), "classes")
        total = docs.agg(F.sum("n")).first()[0] or 0
        ranges = 64
        while ranges < 4096 and total * 3 // ranges > 16 << 20:
            ranges *= 2
        most = max(1, (1 << 20) // ranges)

        def frequent(pick, base):  # 16 MB of bits, below LOW alone, and 8 MB of hashes at most
            counted = self.docs.select("text").mapInArrow(_counted(n, ranges, pick, base), "r int, once binary, many binary, counts binary")
            return counted.groupBy("r").applyInArrow(_frequencies(ranges, most, 32, base), "r int, flags binary, often binary").collect()

        got = frequent(_low, np.uint64(0))
        empty = np.zeros((1 << _BITS) // ranges // 8, np.uint8).tobytes()
        flags = dict((r, bytes(x)) for r, x, _ in got)
        sc = spark.sparkContext
        flags = sc.broadcast(b"".join(flags.get(r, empty) for r in range(ranges)))
        joined = lambda rows: sc.broadcast(np.sort(np.concatenate([np.frombuffer(bytes(x), np.uint64) for _, _, x in rows] or [np.zeros(0, np.uint64)])).tobytes())
        often = joined(got + frequent(_high(num, den, joined(got)), LOW))
        prefixes = self.docs.select("text").mapInArrow(_prefixes(n, num, den, ranges, flags, often, 4 * ranges), "g int, token binary, sig binary, size binary")
        met = work.save(prefixes.groupBy("g").applyInArrow(_meetings(), "token long, sig long, n int, pivot long, pivot_n int"), "met")
        k = self.classes.select(F.col("sig").alias("x"), F.col("sketch").alias("k"))
        stars = met.where((F.col("pivot") != F.col("sig")) & (den * F.least("n", "pivot_n") >= num * F.greatest("n", "pivot_n"))).select(F.col("pivot").alias("a"), F.col("sig").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb")).distinct()
        stars = stars.join(k.withColumnRenamed("k", "ka"), F.col("a") == F.col("x")).drop("x").join(k.withColumnRenamed("k", "kb"), F.col("b") == F.col("x")).drop("x")
        links = self.verified(stars.mapInArrow(_near(num, den), "a long, b long"), "star")
        roots = work.save(connected_components(links, work, "cc0"), "roots0")
        family, heads, mixed = self.families(met, roots)
        links = links.unionByName(self.verified(self.closest(family, heads), "closest"))
        roots = work.save(connected_components(links, work, "cc1"), "roots1")
        links = links.unionByName(self.verified(self.outside(mixed, heads, roots), "outside"))
        roots = work.save(connected_components(links, work, "cc2"), "roots2")
        work.drop("family", "heads", "mixed-now", "hashes", "meeting", "blocks", "classes")
        return docs.select("doc_id", "n", "sig"), roots


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, broadcast_docs: int = 2_000_000, chunk: int = 256, tree: int = 256) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs (doc_id, text).

    Two documents link when den * |intersection| >= num * |union|. Null text is empty
    text; documents without words are linked with nothing. Rows with equal sets, repeated
    rows too, are in one component. A null id ranks below all others. Other columns are dropped;
    an empty table gives no rows; texts of any length count whole. chunk and tree bound how many
    sets are in one prefix tree, not what is found.
    """
    work = Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), "text")
    rows, roots = _Join(docs, n, num, den, work, broadcast_docs, chunk, tree).run()
    placed = work.save(rows.join(roots, F.col("sig") == F.col("node"), "left").select("doc_id", "n", F.coalesce("root", "sig").alias("root")), "rows")
    least = work.save(placed.where("n > 0").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least")), "least")
    out = placed.join(least, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left")
    return out.select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("least", "doc_id"), F.lit(_NULL_ID)).alias("component_id"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_components(load(spark, sf_dir, "documents"), n=4, num=85, den=100)

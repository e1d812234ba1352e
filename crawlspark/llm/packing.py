"""Best-fit packing with large-item matching.

Documents are tokenised and cut into pieces of at most `capacity` tokens. At most two
pieces above a third of the capacity fit in a sequence, so those are matched greedily
first: the longest with the longest that still fits beside it. Shorter pieces then go,
longest first, to the sequence with the least gap that takes them.

Scale: what to put where depends on the number of pieces of each length only, so the
plan is made from a histogram of `capacity` numbers and is a few thousand rules. A
piece's rank among those of its length, counted in parallel (per task, then summed),
tells which rule, sequence and offset it has. Texts are read once and never shuffled;
pieces (some 50 bytes each) meet the counts of the tasks before theirs, which are broadcast
up to `broadcast_rows` rows and meet in a merge join beyond that.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, load, text_slices


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


#: Contractions, runs of other signs and single digits are words of their own, as the vocabulary's tokenizer splits.
_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[^\s\x0b\p{L}\p{N}]+|\p{N})"
#: Any character outside Latin script, common signs and plain white space: such texts go whole to the tokenizer.
_RARE = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"


class WordEncoder:
    """Token ids of texts by a lower-casing tokenizer with word ends (`</w>`) that drops white space.

    Texts are split into chunks at white space and chunks into words, each different
    one once per batch; each different word is encoded once while it is remembered.
    A word ends in exactly one word-end token, so many words are encoded in one call.
    """

    def __init__(self, path: str, remember: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.words, self.remember = Tokenizer.from_file(path), Tokenizer.from_file(path), remember
        #: Texts with the string of a special token, which is that token wherever it stands, go whole to the tokenizer.
        self.special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"\z."
        self.words.encode_special_tokens = True
        self.words.normalizer = None  # words come normalised and split
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.sizes = np.zeros(len(self.ends), np.int64)  # bytes, a character of the vocabulary each
        for t, i in vocab.items():
            self.sizes[i] = len(t.removesuffix("</w>"))
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            # the tokens' bytes are the words' bytes in order, so words end where as many bytes have passed
            if len(last) == len(part) and np.array_equal(np.cumsum(self.sizes[ids])[last], np.cumsum([len(w.encode()) for w in part])):
                self._keep(part, ids, np.diff(last, prepend=-1))
            else:  # a word that this tokenizer splits after all
                each = [e.ids for e in self.words.encode_batch_fast(part, add_special_tokens=False)]
                self._keep(part, np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each)))

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(texts)
        coded = pc.list_flatten(chunks).dictionary_encode()
        lowered = pc.utf8_lower(coded.dictionary)  # all of it is in NFC, or it were rare
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, _SPLIT, r" \1 "))
        inner = pc.list_flatten(words).dictionary_encode()
        names = inner.dictionary.to_pylist()
        if len(self.at) + len(names) > self.remember:
            self.forget()
        self._learn([w for w in names if w not in self.at])
        index = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))[inner.indices.to_numpy()]
        starts, lengths = self.starts[index], self.lengths[index]
        chunk_ids = self.ids[_expand(starts, lengths)]
        chunk_n = np.bincount(np.asarray(pc.list_parent_indices(words)), lengths, minlength=len(coded.dictionary)).astype(np.int64)
        codes = coded.indices.to_numpy()
        n = chunk_n[codes]
        per_text = np.bincount(np.asarray(pc.list_parent_indices(chunks)), n, minlength=len(texts)).astype(np.int64)
        return chunk_ids[_expand((np.cumsum(chunk_n) - chunk_n)[codes], n)], per_text

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        rare = pc.or_(pc.match_substring_regex(texts, _RARE), pc.match_substring_regex(texts, "(?i)" + self.special))
        ids, n = self._split(pc.if_else(rare, "", texts))
        ends = np.cumsum(n)
        out = [ids[b - k : b] for b, k in zip(ends.tolist(), n.tolist())]
        for i in np.flatnonzero(rare.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_encoder: WordEncoder | None = None


def _encoder_of(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    global _encoder
    if _encoder is None:
        _encoder = WordEncoder(path)
    return _encoder


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, map_id int, at long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder, map_id = _encoder_of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in text_slices(batches, 1, 2 << 20):
            out = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                own = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    for column, x in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), map_id, int(seen[len(part)]))):
                        column.append(x)
                    seen[len(part)] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "map_id", "at"])
        encoder.forget()  # the worker lives on through later stages

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, end rank, first sequence, pieces a sequence, first offset) that place all pieces.

    Bins that are alike are kept as one class, (first bin, number of bins), by gap. Every
    step uses up a length or a class, so rules are as many as lengths and classes.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    rules, bins = [], 0

    def put(length: int, first: int, n_bins: int, each: int, gap: int) -> None:
        n = n_bins * each
        rules.append((length, rank[length], rank[length] + n, first, each, capacity - gap))
        rank[length] += n
        left[length] -= n
        if rest := gap - each * length:
            gaps.setdefault(rest, []).append((first, n_bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= min(length, capacity - length) and left[m] and (m != length or left[m] > 1)), None)
            if mate is None:
                n = left[length]
                put(length, bins, n, 1, capacity)
            elif mate == length:
                n = left[length] // 2
                put(length, bins, n, 2, capacity)
            else:
                n = min(left[length], left[mate])
                put(length, bins, n, 1, capacity)
                group = gaps[capacity - length]
                group.pop()
                put(mate, bins, n, 1, capacity - length)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g, x in gaps.items() if g >= length and x), default=None)
            if gap is None:
                each = capacity // length
                n, each = (left[length] // each, each) if left[length] >= each else (1, left[length])
                put(length, bins, n, each, capacity)
                bins += n
                continue
            first, n_bins = gaps[gap].pop()
            each = gap // length
            n, each = (min(n_bins, left[length] // each), each) if left[length] >= each else (1, left[length])
            if n < n_bins:
                gaps[gap].append((first + n, n_bins - n))
            put(length, first, n, each, gap)
    return rules


def _placed(rules: np.ndarray):
    def run(batches):
        keys = (rules[:, 0] << 44) + rules[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            r = rules[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            sequence, offset = r[:, 3] + nth // r[:, 4], r[:, 5] + nth % r[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, broadcast_rows: int = 300_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty text; every document ends in end_id and so has a token, and a text of
    any length is cut whole. Rows with null or repeated ids are packed each for itself. An empty table gives no rows. Other
    columns are dropped. The tokenizer must drop white space and not join across it.
    """
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, capacity, end_id), _PIECES), "pieces")
    per_task = pieces.groupBy("length", "map_id").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("map_id").rowsBetween(W.unboundedPreceding, -1)
    bases = work.save(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    counts = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    rules = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    # as many bases as tasks times lengths: sent out only when few; else no key has more pieces than a task wrote
    few = bases.limit(broadcast_rows + 1).count() <= broadcast_rows  # 20 bytes each
    ranked = pieces.join(F.broadcast(bases.drop("n")) if few else bases.drop("n").hint("merge"), ["length", "map_id"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(_placed(rules), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

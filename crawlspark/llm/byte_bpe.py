"""Byte-level BPE by recursive DuckDB queries within each partition.

A text is split by the vocabulary's pattern. Each different word of a batch that is no
token itself becomes rows (word, position, token), bytes at first. A recursive query
joins neighbouring tokens with the merge table and contracts each word's leftmost pair
of least rank, until no word has a pair left. An ordered aggregation of the tokens'
bytes decodes.

Scale: one pass without a shuffle. A task encodes only words that it does not remember;
what it remembers is bounded by `remember` words, the latest used, and a query by
`batch_bytes`. A word longer than two stretches goes through the query stretch by stretch. Two encodings
may stand side by side if the last token and the first one, encoded together, are those two
tokens again; where they are not, a window around the joint goes through the query anew and
grows until both its ends pass.
Neighbouring bytes that no token holds together part a word into pieces, which the query
contracts side by side, so a long word takes as many steps as its worst piece has
different pairs to contract.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_slices

#: White space beside white space, one of them a space: texts that have it are split by the pattern as a whole.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUNS = f" [{_SPACE}]|[{_SPACE}] "

# A step contracts each word's leftmost pair of least rank, and with it all that must come to the
# same in any order:
# - the pair's other places, where no token that begins or ends with the new one has a lower rank
#   (not `alone`); of matches that follow each other (a run of one token) every second;
# - pairs whose two tokens nothing can take first: whatever grows beside them ends with the byte
#   before or begins with the byte after, and of those bytes `left` and `right` tell whether any
#   token made with one of the two has a lower rank.
# Rows are ordered by `pos`, their place in the batch; a word's last row never matches, so runs end there.
_CONTRACT = """
WITH RECURSIVE step(w, pos, tok, before, own, done) AS (
  SELECT w, pos, tok, before, own, done FROM start_tokens
  UNION ALL
  (WITH near AS (
    SELECT w, pos, tok, before, own, row_number() OVER place AS n,
      CASE WHEN lead(w) OVER place = w THEN lead(tok) OVER place END AS following,
      CASE WHEN lead(w, 2) OVER place = w THEN lead(own, 2) OVER place ELSE 256 END AS after
    FROM step WHERE NOT done WINDOW place AS (ORDER BY pos)),
  pairs AS MATERIALIZED (
    SELECT w, pos, tok, before, own, n, m.id, m.alone, m.id::BIGINT * 4294967296 + pos AS pair,
      m.id IS NOT NULL AND get_bit(m."left", before) = 1 AND get_bit(m."right", after) = 1 AS free
    FROM near LEFT JOIN merges m ON m.l = near.tok AND m.r = near.following),
  least AS (SELECT w, min(pair) AS pair FROM pairs GROUP BY w),
  matched AS (
    SELECT p.w, p.pos, p.tok, p.before, p.own, p.n, p.id, b.pair IS NULL AS done, p.free,
      coalesce(p.pair = b.pair OR p.id = b.pair // 4294967296 AND NOT p.alone, false) AS here
    FROM pairs p JOIN least b ON b.w = p.w),
  runs AS (
    SELECT *, lag(here, 1, false) OVER place AS here_before, lag(free, 1, false) OVER place AS free_before,
      n - coalesce(max(CASE WHEN NOT here THEN n END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth
    FROM matched WINDOW place AS (ORDER BY pos))
  SELECT w, pos, CASE WHEN free OR here AND nth % 2 = 1 THEN id ELSE tok END, before, own, done
  FROM runs WHERE NOT (free_before OR here_before AND nth % 2 = 0)))
SELECT p.word, string_agg(s.tok::VARCHAR, ' ' ORDER BY s.pos) AS ids, string_agg(v.hex, '' ORDER BY s.pos) AS hex, count(*) AS n
FROM step s JOIN pieces p ON p.w = s.w JOIN vocab v ON v.id = s.tok WHERE s.done GROUP BY p.word ORDER BY p.word
"""


def _free(ids: np.ndarray, own: np.ndarray, partner: np.ndarray, byte: np.ndarray, size: int, strict: bool) -> list[bytes]:
    """For each merge, a bit a byte (the 257th: none): no merge of its token with a token at that byte has a lower rank."""
    least = np.full((size, 257), np.iinfo(np.int32).max, np.int32)
    np.minimum.at(least, (partner, byte), ids)
    out = []
    for i in range(0, len(ids), 8192):
        part = least[own[i : i + 8192]]
        limit = ids[i : i + 8192, None]
        bits = np.zeros((len(part), 264), bool)
        bits[:, :257] = part > limit if strict else part >= limit
        out += [x.tobytes() for x in np.packbits(bits, axis=1)]
    return out


class Codec:
    """Encodes and decodes words of one vocabulary in a DuckDB connection of its own."""

    def __init__(self, path: str, pattern: str, remember: int = 800_000, batch_bytes: int = 400_000, stretch: int = 8192):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern, self.remember, self.batch_bytes, self.stretch = regex.compile(pattern), remember, batch_bytes, stretch
        merges = [(left, right, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (left := self.ranks.get(t[:k])) is not None and (right := self.ranks.get(t[k:])) is not None]
        alone = {part for left, right, i in merges for part in (left, right) if part > i}
        # neighbouring bytes that no token holds: words are cut there
        self.apart = np.ones((256, 256), bool)
        for t in self.ranks:
            x = np.frombuffer(t, np.uint8)
            self.apart[x[:-1], x[1:]] = False
        # no spill: a task has no folder of its own to spill to, and a batch is bounded
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        l, r, i = (np.array(x, np.int32) for x in zip(*merges))
        size = max(self.tokens) + 1
        ends = np.zeros((2, size), np.int64)
        for k, t in self.tokens.items():
            ends[:, k] = t[0], t[-1]
        # of what stands before, equal ranks come first; of what follows, later
        left, right = _free(i, l, r, ends[1][l], size, True), _free(i, r, l, ends[0][r], size, False)
        table = pa.table({"l": l, "r": r, "id": i, "alone": [m[2] in alone for m in merges], "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})
        for name, table in (("merges", table), ("vocab", pa.table({"id": pa.array(self.tokens.keys(), pa.int32()), "hex": [t.hex() for t in self.tokens.values()]}))):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given" if name == "vocab" else 'CREATE TABLE merges AS SELECT * REPLACE (CAST("left" AS BIT) AS "left", CAST("right" AS BIT) AS "right") FROM given')
            self.con.unregister("given")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.new: dict[str, tuple[str, bytes, int]] = {}  # words and chunks: ids joined by spaces, decoded bytes, number of tokens
        self.old = self.new

    def _age(self) -> None:
        """Start a generation: what was not used in the one before last is forgotten."""
        if 2 * len(self.new) > self.remember:
            self.old, self.new = self.new, {}

    def _unknown(self, words: list[str]) -> list[str]:
        """Those of words that are not remembered; those of the last generation come into this one."""
        out, new, old = [], self.new, self.old
        for w in words:
            if w not in new:
                if (found := old.get(w)) is None:
                    out.append(w)
                else:
                    new[w] = found
        return out

    def learn(self, words: list[str]) -> None:
        parts = []
        for word in words:
            raw = word.encode()
            if (i := self.ranks.get(raw)) is not None:
                self.new[word] = (str(i), self.tokens[i], 1)
            elif len(raw) > 2 * self.stretch:
                ids = self._long(raw)
                self.new[word] = (" ".join(map(str, ids)), self._bytes(ids), len(ids))
            else:
                parts.append((word, raw))
        self.new.update(zip([word for word, _ in parts], self._contracted([raw for _, raw in parts])))

    def _contracted(self, raws: list[bytes]) -> list[tuple[str, bytes, int]]:
        """Ids joined by spaces, decoded bytes and number of tokens of each, in queries of bounded size."""
        # what is of like length goes together, so that a batch has as many steps as its own words need
        order = sorted(range(len(raws)), key=lambda k: len(raws[k]))
        sizes = np.array([len(raws[k]) for k in order], np.int64)
        bins = (np.cumsum(sizes) - sizes) // self.batch_bytes * 64 + np.ceil(np.log2(np.maximum(sizes, 8))).astype(np.int64)
        cuts = (np.flatnonzero(np.diff(bins)) + 1).tolist()
        out: list = [None] * len(raws)
        for a, b in zip([0, *cuts], [*cuts, len(raws)]):
            if a < b:
                for k, found in zip(order[a:b], self._contract([raws[k] for k in order[a:b]])):
                    out[k] = found
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _encoded(self, raws: list[bytes]) -> list[list[int]]:
        return [[int(x) for x in ids.split()] for ids, _, _ in self._contracted(raws)]

    def _long(self, raw: bytes) -> list[int]:
        """The ids of a long word, from stretches of it whose joints are mended."""
        fit: dict[tuple[int, int], bool] = {}

        def check(pairs) -> None:
            new = sorted({p for p in pairs if p not in fit})
            fit.update((p, ids == list(p)) for p, ids in zip(new, self._encoded([self._bytes(list(p)) for p in new])))

        parts = self._encoded([raw[i : i + self.stretch] for i in range(0, len(raw), self.stretch)])
        for most in (4, 16, 64):  # all joints at once: most encodings fall into step within some tokens
            check((a[-1], b[0]) for a, b in zip(parts, parts[1:]))
            if all(fit[a[-1], b[0]] for a, b in zip(parts, parts[1:])):
                break
            out: list = [parts[0]]
            windows = []  # places in out that hold bytes yet
            for part in parts[1:]:
                if isinstance(out[-1], bytes) or fit[out[-1][-1], part[0]]:
                    out.append(part)
                    continue
                around = self._bytes(out[-1][-most:] + part[:most])
                out[-1] = out[-1][:-most]
                if not out[-1]:
                    out.pop()
                windows.append(len(out))
                out.append(around)
                if part[most:]:
                    out.append(part[most:])
            for k, ids in zip(windows, self._encoded([out[k] for k in windows])):
                out[k] = ids
            parts = out
        # periodic words never do: the rest of each stretch follows from what stands before it
        done = parts[0]
        for part in parts[1:]:
            back = 16
            check([(done[-1], part[0])])
            while not fit[done[-1], part[0]]:
                (ids,) = self._encoded([self._bytes(done[-back:] + part)])
                if len(done) > back:
                    check([(done[-back - 1], ids[0])])
                if len(done) <= back or fit[done[-back - 1], ids[0]]:
                    del done[-back:]
                    part = ids
                    break
                back *= 4
            done.extend(part)
        return done

    def _contract(self, some: list[bytes]) -> list[tuple[str, bytes, int]]:
        """One recursive query for some words, which are cut into pieces where no token can be."""
        lengths = np.array([len(raw) for raw in some])
        data = np.frombuffer(b"".join(some), np.uint8)
        begins = np.append(True, self.apart[data[:-1], data[1:]])
        begins[np.cumsum(lengths) - lengths] = True
        first = np.flatnonzero(begins)
        sizes = np.diff(np.append(first, len(data)))
        word = np.repeat(np.arange(len(some), dtype=np.int32), lengths)[first]
        w = np.repeat(np.arange(len(first), dtype=np.int32), sizes)
        own = data.astype(np.int32)
        before = np.where(begins, 256, np.append(256, own[:-1])).astype(np.int32)
        self.con.register("start_tokens", pa.table({"w": w, "pos": np.arange(len(data)), "tok": self.single[data], "before": before, "own": own, "done": np.repeat(sizes == 1, sizes)}))
        self.con.register("pieces", pa.table({"w": np.arange(len(first), dtype=np.int32), "word": word}))
        got = self.con.sql(_CONTRACT).to_arrow_table()
        self.con.unregister("start_tokens")
        self.con.unregister("pieces")
        if got.num_rows != len(some):
            raise RuntimeError("words were lost")
        return list(zip(got.column("ids").to_pylist(), map(bytes.fromhex, got.column("hex").to_pylist()), got.column("n").to_pylist()))

    def _joined(self, words: list[str]) -> tuple[str, bytes, int]:
        x = list(map(self.new.__getitem__, words))
        return " ".join([a for a, _, _ in x]), b"".join([b for _, b, _ in x]), sum([n for _, _, n in x])

    def _learn_chunks(self, chunks: list[str], texts: list[str]) -> list[list[str]]:
        """Remember new chunks and return the words of whole texts, which are remembered, too."""
        find = self.pattern.findall
        fresh = self._unknown(chunks)
        split = {c: w for c in fresh if (w := find(c)) != [c]}
        alone = [find(x) for x in texts]
        words = set().union(*split.values(), *alone, (c for c in fresh if c not in split))
        self.learn(self._unknown(sorted(words)))
        for c, w in split.items():
            if c not in self.new:
                self.new[c] = self._joined(w)
        return alone

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Number of tokens, ids joined by spaces and decoded bytes of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        # a single space between other characters always begins a match of the pattern
        split = pc.split_pattern(pc.if_else(pa.array(~whole), texts, ""), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        keys = coded.indices.to_numpy().astype(np.int64) * 2 + 1
        keys[offsets[:-1][np.diff(offsets) > 0]] -= 1  # the first of a text has no space before it
        seen = np.zeros(2 * len(coded.dictionary) + 1, bool)
        seen[keys] = True
        used = np.flatnonzero(seen)
        codes = (np.cumsum(seen) - 1)[keys]
        names = coded.dictionary.to_pylist()
        chunks = [" " + names[k >> 1] if k & 1 else names[k >> 1] for k in used.tolist()]
        self._age()
        where = np.flatnonzero(whole).tolist()
        alone = self._learn_chunks(chunks, [texts[i].as_py() for i in where])
        written, decoded, counts = zip(*map(self.new.__getitem__, chunks)) if chunks else ((), (), ())
        n = np.array(counts, np.int64)[codes]
        full = n > 0  # an empty chunk has no tokens
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[full]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]), pa.int32())
        take = pa.array(codes[full])
        ids = pa.array(written, pa.string()).take(take)
        back = pa.array(decoded, pa.binary()).take(take)
        ids = pc.binary_join(pa.ListArray.from_arrays(ends, ids), " ").cast(pa.binary()).to_pylist()
        back = pc.binary_join(pa.ListArray.from_arrays(ends, back), b"").to_pylist()
        totals = np.bincount(doc, n[full], minlength=len(texts)).astype(np.int64)
        for i, found in zip(where, alone):
            x, back[i], totals[i] = self._joined(found)
            ids[i] = x.encode()
        return totals, ids, back


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    """One for all tasks of a Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text); with_ids adds ids, a string of decimals.

    Null text equals empty text, which has no tokens. Rows repeat as often as in docs, those
    with null ids, too; texts of any length are encoded whole; an empty table gives no rows;
    other columns are dropped.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        codec = codec_of(path, pattern)
        for batch in text_slices(batches, 1, 6 << 20):
            n, ids, back = codec.encode(batch.column(1))
            columns = [batch.column(0), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in ids], pa.string())] * with_ids, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

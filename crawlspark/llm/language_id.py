"""Language identification by the nearest centroid of TF-IDF n-gram vectors.

A text is its words' letters, lower-cased; its vector counts the 1- to 3-grams of
bytes within words and their borders, hashed into `dims` features, weighted by
inverse document frequency and scaled to length 1. Spherical k-means gives several
centroids per language. A text gets the language of the nearest centroid by cosine;
when even that is farther than texts of the language lie from centroids learned
without them, the text is rejected. How far that is depends on how much a text says
(one word lies at up to 0.9 in its own language, a page at 0.1), so the limit is learned
a language and a power of two of different n-grams in the text, from whole texts and from
stretches of 1 to 64 words of them. What one or two words leave undecided stays accepted.

Training reads a bounded sample: `per_lang` texts a language by hash of the id, at
most `max_sample` in all, as packed vectors and one stretch each, of which the driver unpacks
a language's at a time. A cut by hash, from the counts,
goes before the ranking, so no task gathers more than some thousands of ids. Prediction is one pass over all
texts without a shuffle; the centroids are the only thing sent out (256 KB for four languages).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load, text_slices

DIMS = 4096
UNKNOWN = "und"
#: Texts whose vectors (16 KB each, a few times over) are held together.
_ROWS = 128
#: Limits are learned for 2^k to 2^(k+1) different n-grams, k below this.
LEVELS = 13
#: Words of the stretches that short texts' limits are learned from.
STRETCHES = (1, 2, 4, 8, 16, 32, 64)


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def word_features(words: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words, with the start and number of each word's."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar(" "), "").cast(pa.large_binary())
    offsets = np.frombuffer(padded.buffers()[1], np.int64, len(padded) + 1, padded.offset * 8)
    data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    left = offsets[1:][word_of] - np.arange(len(data))  # bytes from here to the word's end
    feats, owners = [], []
    code = np.zeros(len(data), np.uint64)
    for n in (1, 2, 3):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(n == 1)
        h = code * np.uint64(0x9E3779B97F4A7C15)
        ok = left[: len(code)] >= n
        if n == 1:
            ok &= data != 32
        feats.append(((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int32)[ok])
        owners.append(word_of[: len(code)][ok])
    owner, feat = np.concatenate(owners), np.concatenate(feats)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(lengths))
    return feat[order], np.cumsum(counts) - counts, counts


def vectors(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Term counts of each text, a row each; null and texts without letters are zero."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    docs = np.asarray(pc.list_parent_indices(split))
    encoded = pc.list_flatten(split).dictionary_encode()
    words = encoded.dictionary
    if not len(words):
        return np.zeros((len(texts), dims), np.float32)
    pairs, weight = np.unique(docs.astype(np.int64) * len(words) + encoded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(pairs, len(words))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False)[word] > 0  # a text without letters splits into one empty word
    doc, word, weight = doc[real], word[real], weight[real]
    feat, starts, counts = word_features(words, dims)
    n = counts[word]
    where = np.repeat(doc * dims, n) + feat[_expand(starts[word], n)]
    return np.bincount(where, np.repeat(weight, n), minlength=len(texts) * dims).reshape(len(texts), dims).astype(np.float32)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # largest cosine distance of each centroid, a column for each level of different n-grams
    dims: int = DIMS

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """lang, score and rejected of each text."""
        v = vectors(texts, self.dims)
        none = ~v.any(axis=1)
        at = levels(v)
        if not self.langs:  # nothing was learned
            return [UNKNOWN] * len(v), np.zeros(len(v)), np.ones(len(v), bool)
        v = unit(v * self.idf)
        cosines = np.clip(v @ self.centroids.T, 0.0, 1.0)
        best = cosines.argmax(axis=1)
        score = cosines[np.arange(len(best)), best].astype(float)
        score[none] = 0.0
        langs = [UNKNOWN if x else self.langs[b] for b, x in zip(best, none)]
        return langs, score, none | (1.0 - score > self.limits[best, at])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def levels(v: np.ndarray) -> np.ndarray:
    """Power of two of the different n-grams of each text."""
    return np.minimum(np.log2(np.maximum(np.count_nonzero(v, axis=1), 1)).astype(int), LEVELS - 1)


def stretch(text: str) -> str:
    """Up to 64 whole words from the second third of a text."""
    at = len(text) // 3 if len(text) > 2000 else 0
    words = re.findall(r"[^\W\d_]+", text[at : at + 1500])
    if at:
        words = words[1:]
    if at + 1500 < len(text):
        words = words[:-1]
    return " ".join(words[: STRETCHES[-1]])


def left_out_distances(v: np.ndarray, folds: np.ndarray, stretches: list[str], idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels, distances) of one language's texts, and of stretches of them, to centroids learned without their fold."""
    dims, found = len(idf), []
    for f in sorted(set(folds)):
        if (folds == f).all():  # nothing to learn from without it
            continue
        c = _clustered(v[folds != f], k)
        out = np.flatnonzero(folds == f)
        found.append((levels(v[out]), 1.0 - (v[out] @ c.T).max(axis=1)))
        cut = [stretches[i].split(" ") for i in out if stretches[i]]
        pieces = [" ".join(w[:n]) for w in cut for n in STRETCHES if n <= len(w)]
        for start in range(0, len(pieces), 256):
            u = vectors(pa.array(pieces[start : start + 256]), dims)
            u = u[u.any(axis=1)]
            found.append((levels(u), 1.0 - (unit(u * idf) @ c.T).max(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0))


def learn_limits(seen: dict[str, tuple[np.ndarray, np.ndarray]], quantile: float, slack: float, largest: float) -> dict[str, np.ndarray]:
    """Largest distance of each language at each level, from its (levels, distances): the quantile and slack (a share of the way from there to 1) more.

    A level with few texts takes all languages' distances or, where those are few too,
    the limit of the level below it; nothing known is `largest`.
    """
    everyone = tuple(np.concatenate(x) for x in zip(*seen.values()))
    limits = {}
    for lang in seen:
        row = np.full(LEVELS, largest)
        for level in range(LEVELS):
            own, every = (d[at == level] for at, d in (seen[lang], everyone))
            d = own if len(own) >= 30 else every
            if len(d) >= 30:
                q = float(np.quantile(d, quantile))
                row[level] = min(largest, q + slack * (1.0 - q))
            elif level:
                row[level] = row[level - 1]
        limits[lang] = row
    return limits


def _clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the first vector and the farthest ones after it."""
    chosen = [0]
    nearest = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = unit(np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(train: DataFrame, centroids_per_lang: int = 4, per_lang: int = 800, max_sample: int = 8000, dims: int = DIMS, quantile: float = 0.995, slack: float = 0.1, largest: float = 0.98) -> Model:
    """Fit on a bounded sample of train (doc_id, text, lang).

    Rows with null lang, null doc_id or text without letters are not used; of rows that repeat
    an id and lang the one with the least text is. With nothing to learn from, the model has no
    language and all texts are und, score 0, rejected.
    """
    train = train.select(F.col("doc_id").cast("long"), "text", "lang")
    usable = train.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # a cut by hash leaves about four times what is wanted of each language, whatever the input; only that is ranked
    cut = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), F.least(F.lit(1.0), 4.0 * per_lang / F.col("n")).alias("share")))
    passed = rows.join(cut, F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1 << 32)) < F.col("share") * float(1 << 32)).select("doc_id", "lang", "h").distinct()
    ranked = passed.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= per_lang)
    ids = [tuple(r) for r in ranked.orderBy("n", "h", "doc_id", "lang").limit(max_sample).select("doc_id", "lang").collect()]

    def encode(batches):
        for batch in text_slices(batches, 0, 1 << 19, _ROWS):
            v = vectors(batch.column(0), dims)
            pieces = [stretch(x or "") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.string()), pa.array([zlib.compress(x.tobytes(), 1) for x in v], pa.binary()), pa.array(pieces, pa.string())], names=["lang", "v", "piece"])

    spark = train.sparkSession
    # max_sample rows at most; a list would go through Python workers of their own
    chosen = F.broadcast(spark.createDataFrame(pa.table([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.string())], names=["chosen", "chosen_lang"])))
    sample = usable.join(chosen, (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("chosen_lang")), "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    packed: dict[str, list[tuple[bytes, str]]] = {}  # vectors are sparse, so packed ones take a tenth or less
    for lang, x, piece in sample.select("text", "lang").mapInArrow(encode, "lang string, v binary, piece string").collect():
        packed.setdefault(lang, []).append((bytes(x), piece))
    if not packed:
        return Model([], np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros((0, LEVELS)), dims)
    frequency = np.zeros(dims, np.int64)
    for rows in packed.values():
        for x, _ in rows:
            frequency += np.frombuffer(zlib.decompress(x), np.float32) > 0
    idf = (np.log((1 + sum(map(len, packed.values()))) / (1 + frequency)) + 1).astype(np.float32)
    centers, seen = {}, {}
    for lang in sorted(packed):  # one language's vectors at a time are unpacked
        rows = sorted((zlib.decompress(x), piece) for x, piece in packed.pop(lang))
        folds = np.array([zlib.crc32(x) % 5 for x, _ in rows])  # equal texts are in one
        pieces = [piece for _, piece in rows]
        v = np.empty((len(rows), dims), np.float32)
        for i, (x, _) in enumerate(rows):
            v[i] = np.frombuffer(x, np.float32)
        del rows
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        seen[lang] = left_out_distances(v, folds, pieces, idf, centroids_per_lang)
        centers[lang] = _clustered(v, centroids_per_lang)
    limit = learn_limits(seen, quantile, slack, largest)
    langs = [lang for lang, c in centers.items() for _ in c]
    return Model(langs, np.concatenate(list(centers.values())).astype(np.float32), idf, np.array([limit[lang] for lang in langs]), dims)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (cosine) and rejected: all rows and columns of docs stay, clashing ones are replaced.
    prefix goes before the names of the new columns.

    Null text and texts without a letter are und, score 0, rejected. Ids are not read, so null
    and repeated ones are like others; texts of any length are read whole; an empty table gives no rows.
    """
    new = [prefix + n for n in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*new)
    at = docs.columns.index("text")

    def run(batches):
        for batch in text_slices(batches, at, 1 << 19, _ROWS):
            langs, score, rejected = model.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, *new])

    from pyspark.sql import types as T

    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

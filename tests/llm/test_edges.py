"""Empty tables, null and repeated ids, null, empty and very long texts, and columns with clashing names, for every operator."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from crawlspark.llm import byte_bpe, exact_dedup, language_id, line_dedup, ngram_join, packing, secret_scan, suffix_dedup, topk_search, warc
from crawlspark.llm.common import Workspace

#: Names that operators use inside.
CLASHES = "sig n row rid code codes block name kept keep_id group_size spans redacted rejected lang_pred score piece start length map_id at h1 h2 batch max_doc token root node lo text_sha256 n_chars lang source".split()
SECRET = 'password = "Xk9#mQ2$vL8zz"'
LONG = "\n".join(f"line {k} of a very long text, {k * k % 977} and more words {'z' * (k % 50)}" for k in range(30_000)) + f"\n{SECRET}\n" + "y" * 200_000
ROWS = [(None, None), (None, "some text"), (None, "some text"), (1, ""), (1, ""), (2, None), (3, LONG), (3, "another text under one id"), (4, LONG.upper()), (5, " \n\t"), (6, "12 34 !?"), (7, "é" * 300)]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES))).cache()


def tokenizer_paths():
    import public_tokenizers as P

    return P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


OPERATORS = {
    "secret_scan": secret_scan.secret_scan,
    "similar_components": ngram_join.similar_components,
    "exact_dedup": exact_dedup.exact_dedup,
    "pack": lambda d: packing.pack(d, tokenizer_paths()[0]),
    "identify": lambda d: language_id.identify(d, language_id.fit(d)),
    "bpe_round_trip": lambda d: byte_bpe.bpe_round_trip(d, *tokenizer_paths()[1:]),
    "line_dedup": line_dedup.line_dedup,
    "remove_repeats": suffix_dedup.remove_repeats,
    "redact_secrets": secret_scan.redact_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []
    got = OPERATORS[name](odd)
    ids = got.where("piece = 0") if name == "pack" else got
    assert sorted(str(r.doc_id) for r in ids.select("doc_id").collect()) == sorted(str(i) for i, _ in ROWS)
    no_id = odd.withColumn("doc_id", F.lit(None).cast("long"))
    again = OPERATORS[name](no_id)
    assert (again.where("piece = 0") if name == "pack" else again).count() == len(ROWS)


def test_exact_dedup_values(odd):
    groups = Counter(low(t) for _, t in ROWS)
    want = Counter((hashlib.sha256(low(t).encode()).hexdigest(), groups[low(t)]) for _, t in ROWS)
    got = exact_dedup.exact_dedup(odd).collect()
    assert Counter((x.text_sha256, x.group_size) for x in got) == want and sum(x.kept for x in got) == len(groups)


def test_packing_values(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_paths()[0])
    want = Counter()
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[i, p, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packing.pack(odd, tokenizer_paths()[0]).collect()) == want


def test_byte_bpe_values(odd):
    import tiktoken

    _, path, pattern = tokenizer_paths()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert Counter(map(tuple, byte_bpe.bpe_round_trip(odd, path, pattern).collect())) == want


def test_line_dedup_values(odd):
    holders = {}
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            holders.setdefault(low(x).strip(" \t\n\x0b\x0c\r"), set()).add(i)
    gone = {k for k, v in holders.items() if len(k) >= 20 and len(v) >= 2}
    assert len(gone) > 1000
    last = {k: max(i for i in holders[k] if i is not None) for k in gone}
    want = Counter()
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := low(x).strip(" \t\n\x0b\x0c\r")) not in gone or last[k] == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.line_dedup(odd, min_docs=2).collect()) == want


def test_suffix_dedup_values(odd):
    got = {(x.doc_id, x.n_bytes): x for x in suffix_dedup.remove_repeats(odd, kept="bytes").collect()}
    of = lambda i, t: got[i, len((t or "").encode())]
    assert of(1, "").n_removed == 0 and of(2, None).n_bytes == 0
    run = of(3, LONG)  # the run of one letter repeats within the text; its copy in upper case is other bytes
    assert run.n_removed >= 200_000 and run.n_spans >= 1 and bytes(run.kept).startswith(b"line 0 of a very long text")
    assert of(7, "é" * 300).n_removed == 600


def test_secrets_in_long_texts(odd):
    at = LONG.index(SECRET)
    value = at + SECRET.index("Xk9")
    spans = [x.spans for x in secret_scan.secret_scan(odd).collect() if x.doc_id == 3]
    assert f"guess:{value}:{value + 13}" in spans
    clean = [x for x in secret_scan.redact_secrets(odd).collect() if x.doc_id == 3 and len(x.text) > 1000][0]
    assert "Xk9#" not in clean.text and clean.n_chars == str(len(clean.text))
    assert all(x.n_chars.startswith("x") for x in secret_scan.redact_secrets(odd).collect() if x.doc_id != 3 and x.doc_id != 4)


def test_top_k_and_warc_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, row string, v string")
    assert topk_search.top_k(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], "a", "b"), (0, [1.0, 2.0], "a", "b"), (None, [1.0], "a", "b"), (1, [0.5], "a", "b"), (2, [], "a", "b")], "vec_id long, embedding array<float>, row string, v string")
    got = Counter(map(tuple, topk_search.top_k(one).collect()))
    each = [(0, 1, 0, 64 * 64 + 128 * 128), (0, 2, 1, 64 * 32), (0, 3, 2, 0)]
    assert got == Counter(each * 2)
    big = "<p>" + "é" * 1_500_000
    rows = [(None, "u", big), (None, None, big), (1, "v", None), (1, "v", ""), (1, "v", big), (2, "w", big), (2, "w", big)]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, sha string, archive string, offset string").repartition(2)
    for few in (0, 100):
        work = Workspace(spark, "warc-edges")
        got = warc.read_records(warc.write_archives(pages, work, broadcast_groups=few), work, with_payload=True).collect()
        assert Counter((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in got) == Counter((i, len((h or "").encode()), "revisit" if h and i != 2 else "response", 2 if h and i != 2 else None) for i, _, h in rows)
        assert all(x.payload == big for x in got if x.page_id == 2)
    work = Workspace(spark, "warc-none")
    assert warc.read_records(warc.write_archives(pages.limit(0), work), work).collect() == []


def test_pipeline_stages_on_odd_tables(odd):
    docs = odd
    for _, stage in C.STAGES[:-1]:
        got = stage(docs.sparkSession, docs, "")
        assert got.columns == docs.columns
        got.collect()
    kept = [(x.doc_id, x.text) for x in C.exact_stage(odd.sparkSession, odd, "").collect()]
    assert Counter(low(t) for _, t in kept) == Counter({low(t): 1 for _, t in ROWS})
    assert [i for i, t in kept if low(t) == low(LONG)] == [4] and [i for i, t in kept if not t] == [2]

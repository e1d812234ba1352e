"""Stages of the pipeline on a small corpus."""

import re

import corpus_pipeline as C


def corpus(spark):
    r = __import__("random").Random(4)
    words = {"en": "the of and ing with tion over under house".split(), "es": "que los una ción por ñar casa para".split()}
    prose = lambda g, n: " ".join(r.choice(words[g]) + r.choice("abcdefgh") for _ in range(n))
    rows = [(i, prose(g, 60), g, "s", 0, "more") for i, g in enumerate(["en", "es"] * 20)]
    base = rows[0][1]
    rows += [(100, base.upper(), "en", "s", 0, "more"), (101, base + " extra", "en", "s", 0, "more"), (102, "12 34", "en", "s", 0, "more"), (103, None, "en", "s", 0, "more"), (104, prose("en", 30) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s", 0, "more"), (105, "мир привет как дела", None, "s", 0, "more")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id string").repartition(3)


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    ids = lambda df: {r.doc_id for r in df.collect()}
    seen = [ids(docs)]
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append(ids(docs))
        assert docs.count() == len(seen[-1])
    clean = set(range(1, 40)) | {104}
    assert seen[1] == seen[0] - {102, 103, 105}
    assert seen[2] == seen[1] - {0}  # the copy with the larger id stays
    assert seen[3] == seen[2] - {101} or seen[3] == seen[2] - {100}
    assert seen[4] == seen[3] and clean <= seen[4]
    row = docs.where("doc_id = 104").first()
    assert "[SECRET]" in row.text and not re.search("[0-9a-f]{24}", row.text) and row.n_chars == len(row.text)
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert {x.doc_id for x in packed} == seen[4]


def test_stages_take_empty_tables(spark):
    docs = corpus(spark).limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    import random
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from crawlspark.llm import language_id, secret_scan

    r = random.Random(11)
    vocab = {g: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for g, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    prose = lambda g, n: " ".join(r.choice(vocab[g]) for _ in range(n))
    rows = [(i, prose(g, r.choice([3, 20, 80, 300])), g) for i, g in enumerate(["aa", "bb"] * 40)]
    for k in range(30):  # near copies of some, a few words changed
        words = rows[r.randrange(10) * 2][1].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "zq" + str(k)
        rows.append((200 + k, " ".join(words), "aa"))
    rows += [(300 + k, rows[k * 3][1].upper(), None) for k in range(10)]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 34", "aa"), (403, "мир привет как дела сегодня", None), (404, prose("bb", 50) + ' api_key: "q7Hf3kLp9Zx0" ' + prose("bb", 5), "bb"), (405, "<|endoftext|> " + prose("aa", 40), "aa")]
    table = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in C.run(spark, f"file://{tmp_path}").collect()}

    model = language_id.fit(table)
    rejected = {x.doc_id for x in language_id.identify(table, model).where("rejected").collect()}
    assert {400, 401, 402, 403} <= rejected and len(rejected) < 10
    left = {i: t for i, t, _ in rows if i not in rejected}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    largest = {}
    for i, t in left.items():
        largest[t.translate(lower)] = max(i, largest.get(t.translate(lower), -1))
    left = {i: left[i] for i in largest.values()}
    sets = {}
    for i, t in left.items():
        w = t.translate(lower).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in left:
        for b in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    assert len(left) < len(root)
    left = {i: secret_scan.redact(t, secret_scan.find_spans(t)[0]) for i, t in left.items()}
    assert "[SECRET]" in left[404]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, text in left.items():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[i, p] = (start, len(part), zlib.crc32(part.tobytes()))
    assert got == want

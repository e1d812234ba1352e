"""What the review of round 1 found missing."""

import random

import pyarrow as pa
import pyarrow.compute as pc

from crawlspark.llm import language_id, secret_scan


def test_language_id_rejects_what_was_not_learned(spark):
    r = random.Random(2)
    parts = {"aa": "der die und nicht ein sch heit", "bb": "the of and ing with tion er", "cc": "que los una ción por ñar as"}

    def word(g):
        return "".join(r.choice(parts[g].split()) for _ in range(r.randint(1, 2)))

    data = [(i, " ".join(word(g) for _ in range(r.choice([1, 3, 20, 200]))), g) for i, g in enumerate("aa bb cc".split() * 100)]
    italian = "Il governo ha annunciato ieri che la nuova legge sulla sicurezza stradale entrerà in vigore dal prossimo anno, dopo una lunga discussione in parlamento"
    letters = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60))
    docs = spark.createDataFrame(data + [(900, italian, None), (901, letters, None), (902, "мир привет как дела", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 5 > 0"))
    got = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert [got[i].rejected for i in (900, 901, 902)] == [True] * 3
    held = [got[i] for i in range(0, 300, 5)]
    assert sum(x.rejected for x in held) <= 1
    assert all(x.lang_pred == data[x.doc_id][2] for x in held if len(x.text) > 60)


def test_secret_scan_reads_whole_values():
    for text, value in (
        ('password = "hunter2024!Xy$9kQz"', "hunter2024!Xy$9kQz"),
        ("password: changeme!R7$kq#Zw2", "changeme!R7$kq#Zw2"),
        ("token:      abcdef1!R7$kq#Zw2, then", "abcdef1!R7$kq#Zw2"),
        ("secret = 'Xy$9kQz!#w2?!' # old", "Xy$9kQz!#w2?!"),
    ):
        spans, _ = secret_scan.find_spans(text)
        at = text.index(value)
        assert (at, 3, at + len(value)) in spans
        left = secret_scan.redact(text, spans)
        assert "[SECRET]" in left and not any(value[k : k + 3] in left for k in range(len(value) - 2))
    base = [x for x in secret_scan.find_spans('password = "hunter2024!Xy$9kQz"')[0] if x[1] < 3]
    assert base == [(0, 0, 22)]


def test_secret_filter_accepts_what_context_finds(spark):
    spaces = ["", " ", "\t", "\x0b", "\x1c", "\x85", " ", " ", " ", "　"]
    texts = [f"{name}{a}{sign}{b}Xk9#mQ2$vLz" for name in secret_scan._CREDENTIALS for a in spaces for b in spaces for sign in (":", "=", "->", "=>", "is", "was")]
    texts = [t for x in texts for t in (x, x.upper()) if secret_scan.CONTEXT.search(t)]
    assert len(texts) > 5000
    assert all(pc.match_substring_regex(pa.array(texts), secret_scan._MAY_CONTEXT).to_pylist())
    docs = spark.createDataFrame([(1, "Password : Xk9#mQ2$vLz"), (2, "passphrase is Xk9#mQ2$vLz")], "doc_id long, text string")
    assert [x.n_guess for x in secret_scan.secret_scan(docs).collect()] == [1, 1]
    assert not any("Xk9" in x.text for x in secret_scan.redact_secrets(docs).collect())


def test_secret_scan_leaves_prose():
    for text in (
        "The password is required for every account, and the token is invalid after a week.",
        "Her secret was patience; the login was different, the passcode is forgotten.",
        "The private key is encrypted, the access key was compromised: the bearer is unavailable.",
        "Le secret: patience. Token: invalide, login: impossible, credential: perdu; access key: nécessaire.",
        "Login: falsch. Token: vergessen, secret: geheim, passphrase: unbekannt; access key: notwendig.",
        "Login: importante. Token: siguiente, secret: incorrecta, password: completamente.",
    ):
        assert [x for x in secret_scan.find_spans(text)[0] if x[1] == 3] == [], text
    for value in ("xkqzvbnmwe", "Xk9#mQ2$vLz", "q7Hf3kLp9", "kXwPqzLmRt"):
        assert secret_scan.find_spans(f"the password is {value}")[0] == [(16, 3, 16 + len(value))]

"""Personal data: patterns propose spans, checksums confirm them, context words move the score. DataFrame functions only.

For each kind, split() gives the gaps between the matches of its pattern and
regexp_extract_all() the matches; running sums of their lengths are the offsets. Patterns
are possessive and start where a run of their characters starts (or where the last match
ended), which finds what the plain patterns find, in time linear in the text and without
recursion of the regular expression engine.

Scale: texts stay in their scan task; what is shuffled, once, is a row a match (kind,
lengths, score, matched string) and a row a document, dealt by a number of the row, so no
document, source or group of copies is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Kinds in the order that breaks ties of spans that start together: pattern, and a quick one without which no match of a text passes its check.
PATTERNS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", rf"@{_LABEL}"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4})++(?:\x20?+[0-9][A-Z0-9]{0,2})?+", r"[A-Z]{2}[0-9]{2}\x20?+[A-Z0-9]{4}"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-"),
}
BASE = ("email", "ip", "card", "phone")
#: A card number of 13 digits has no span of its own in the base: it needs context.
KINDS = (*BASE, "iban", "ssn", "card13")
#: Score without context, words that raise it by 0.3 and words that lower it by 0.3.
CONTEXT = {
    "email": (0.8, "e-?mail|mail|contact|kontakt|contacto|courriel|write to|reply", ""),
    "ip": (0.5, "ip|host|server|address|addr|login|client", "version|release|section|chapter|build"),
    "card": (0.7, "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte", "isbn|order|tracking"),
    "phone": (0.6, "phone|tel|call|fax|mobile|cell|whatsapp|telefon|telefono|appelez", ""),
    "iban": (0.7, "iban|bank|account|konto|cuenta|compte|transfer|bic|swift", ""),
    "ssn": (0.3, "ssn|social security|social", ""),
    "card13": (0.3, "card|visa|credit|debit|payment|karte|tarjeta|carte", "isbn|ean|order|tracking"),
}
#: Spans beyond the base stay from this score on.
LEAST = 0.5
BEFORE, AFTER = 40, 20


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    terms = F.transform(at, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check: the country and check digits go last, letters count from 10, the remainder is 1."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c < "A", 10).otherwise(100) + value(c)) % 97) == 1


def _kind(name: str, m: Column, before: Column, after: Column) -> Column:
    """The kind that match m of a pattern is, null if it fails its check."""
    # case expressions guard each other: checksums see only strings of a bounded length
    if name == "ip":
        return F.when(m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+(?:\.|$)){4}$"), "ip")
    if name == "card":
        n = F.length(_digits(m))
        return F.when(~n.between(13, 19), None).when(~luhn(_digits(m)), None).when(n == 13, "card13").otherwise("card")
    if name == "phone":
        return F.when(F.length(_digits(m)).between(10, 15), "phone")
    if name == "iban":
        compact = F.replace(m, F.lit(" "), F.lit(""))
        alone = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
        return F.when(~F.length(compact).between(15, 34) | ~alone, None).when(mod97(compact), "iban")
    if name == "ssn":
        alone = ~before.rlike("[0-9-]$") & ~after.rlike("^-?[0-9]")
        return F.when(alone & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn")
    return F.lit(name)


def _says(words: str, context: Column) -> Column:
    return F.when(context.rlike(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"), 3).otherwise(0) if words else F.lit(0)


def score(kind: Column, context: Column) -> Column:
    """The score of a span of that kind, from 0 to 1, with lower-case context around it."""
    out = F.lit(None)
    for k, (own, up, down) in CONTEXT.items():
        tenths = F.lit(round(own * 10)) + _says(up, context) - _says(down, context)
        out = F.when(kind == k, F.least(F.lit(10), tenths) / F.lit(10.0)).otherwise(out)
    return out


def _matches(text: Column, name: str) -> Column:
    pattern, needs = PATTERNS[name]
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _gaps(text: Column, name: str, matches: str) -> Column:
    return F.when(F.size(matches) > 0, F.split(text, PATTERNS[name][0], -1))


def _candidates(name: str) -> Column:
    """An array with a struct a match of a pattern: its number, the lengths of the gap before it and of itself, kind, score, text."""

    def one(m, i):
        gap, after = F.get(f"g_{name}", i), F.left(F.get(f"g_{name}", i + 1), F.lit(AFTER))
        before = F.right(gap, F.lit(BEFORE))
        return F.struct(F.lit(list(PATTERNS).index(name)).alias("p"), i.alias("i"), F.length(gap).alias("gap"), F.length(m).alias("len"), _kind(name, m, before, after).alias("kind"), F.lower(F.concat(before, F.lit(" "), after)).alias("context"), m.alias("text"))

    return F.transform(f"m_{name}", one)


def pii_scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans, sorted by start: structs of start, end (code points, exclusive), kind, score, base, text.

    Reads doc_id and text; a row of docs is a row here, with null and repeated ids as they
    are. Null and empty texts have no spans; texts of any length are read whole; an empty
    table gives no rows. Spans of one kind never overlap, those of different kinds may. Base spans
    (email, ip, card, phone) that pass their check stay whatever their score; spans of the
    other kinds (an IBAN that passes mod 97, a social security number, a card number of 13 digits
    that passes Luhn) stay from a score of LEAST on. Context is what lies up to 40 code points before and 20 behind a match, and
    between it and its neighbours of the same pattern.
    """
    text = F.col("text")
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cut = read.select("*", *(_matches(text, k).alias(f"m_{k}") for k in PATTERNS))
    cut = cut.select("*", *(_gaps(text, k, f"m_{k}").alias(f"g_{k}") for k in PATTERNS))
    none = F.array().cast("array<struct<p:int,i:int,gap:int,len:int,kind:string,context:string,text:string>>")
    each = cut.select("row", "doc_id", F.explode_outer(F.concat(*(F.coalesce(_candidates(k), none) for k in PATTERNS))).alias("c")).select("row", "doc_id", "c.*")
    kind = F.col("kind")
    scored = each.withColumn("score", score(kind, F.col("context"))).drop("context").withColumn("text", F.when(kind.isNotNull(), F.col("text")))
    placed = scored.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "p").orderBy("i")))
    base = kind.isin(*BASE)
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), order.alias("order"), "end", "kind", "score", base.alias("base"), "text")
    spans = F.array_sort(F.collect_list(F.when(base | (F.col("score") >= LEAST), span)))
    fields = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "score", "base", "text"))))
    return placed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), fields.alias("spans")).drop("row")


def redact_pii(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with the spans of these kinds replaced by [EMAIL], [IP], ... in text; all other columns as they are.

    Kinds are masked one after the other, in their order, each in what the others have left. Null texts stay null.
    """
    out, text = docs, F.col("text")
    g, m = "_", "__"
    while {f"{g}{k}" for k in "gm"} & set(docs.columns):
        g += "_"
    m, g = f"{g}m", f"{g}g"
    for name in PATTERNS:
        def mask(x, i):
            before, after = F.right(F.get(g, i), F.lit(BEFORE)), F.left(F.get(g, i + 1), F.lit(AFTER))
            kind = _kind(name, x, before, after)
            keep = kind.isin(*kinds) & (kind.isin(*BASE) | (score(kind, F.lower(F.concat(before, F.lit(" "), after))) >= LEAST))
            return F.concat(F.get(g, i), F.when(keep, F.concat(F.lit("["), F.upper(kind), F.lit("]"))).otherwise(x))

        out = out.withColumn(m, _matches(text, name))
        out = out.withColumn(g, _gaps(text, name, m))
        whole = F.array_join(F.concat(F.transform(m, mask), F.slice(g, -1, 1)), "")
        out = out.withColumn("text", F.when(F.size(m) > 0, whole).otherwise(text)).drop(m, g)
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_scan(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023  filter() calls it at once
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


#: The patterns as stated, for a linear-time engine without look-behind.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4})+(?:\x20?[0-9][A-Z0-9]{0,2})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_SQL_CASES = "\n".join(
    f"    WHEN kind = '{k}' THEN {own} " + (f"+ CASE WHEN regexp_matches(context, '(?:^|[^a-z])(?:{up})(?:[^a-z]|$)') THEN 0.3 ELSE 0 END " if up else "") + (f"- CASE WHEN regexp_matches(context, '(?:^|[^a-z])(?:{down})(?:[^a-z]|$)') THEN 0.3 ELSE 0 END" if down else "")
    for k, (own, up, down) in CONTEXT.items()
)
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
g AS ({" UNION ALL ".join(f"SELECT r, '{k}' AS p, regexp_extract_all(t, '{x}') AS ms, string_split_regex(t, '{x}') AS gs FROM d" for k, x in _SQL_PATTERNS.items())}),
m AS (SELECT r, p, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap, unnest(gs[2:]) AS next FROM g WHERE len(ms) > 0),
e AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, p ORDER BY i) AS BIGINT) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS c,
  lower(right(gap, {BEFORE}) || ' ' || left(next, {AFTER})) AS context FROM m),
k AS (SELECT *, CASE
    WHEN p = 'email' THEN 'email'
    WHEN p = 'ip' THEN CASE WHEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS BIGINT), 0) > 255)) = 0 THEN 'ip' END
    WHEN p = 'card' THEN CASE WHEN length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(dg[-j] AS INT) WHEN CAST(dg[-j] AS INT) > 4 THEN 2 * CAST(dg[-j] AS INT) - 9 ELSE 2 * CAST(dg[-j] AS INT) END)) % 10 = 0
      THEN CASE WHEN length(dg) = 13 THEN 'card13' ELSE 'card' END END
    WHEN p = 'phone' THEN CASE WHEN length(dg) BETWEEN 10 AND 15 THEN 'phone' END
    WHEN p = 'iban' THEN CASE WHEN length(c) BETWEEN 15 AND 34 AND NOT regexp_matches(gap, '[A-Za-z0-9]$') AND NOT regexp_matches(next, '^[A-Za-z0-9]')
      AND list_reduce(list_transform(string_split(c[5:] || c[1:4], ''), lambda x: CAST(CASE WHEN x < 'A' THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS BIGINT)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 THEN 'iban' END
    WHEN p = 'ssn' THEN CASE WHEN NOT regexp_matches(gap, '[0-9-]$') AND NOT regexp_matches(next, '^-?[0-9]') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') THEN 'ssn' END
  END AS kind FROM e),
s AS (SELECT r, kind, e - length(m) AS s, e, kind IN ('email', 'ip', 'card', 'phone') AS base, list_position({list(KINDS)}, kind) AS o, CASE
{_SQL_CASES} END AS score FROM k WHERE kind IS NOT NULL),
j AS (SELECT *, kind || ':' || s || ':' || e AS x FROM s WHERE base OR score >= {LEAST})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (j.kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (base), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, o), '') AS spans
FROM d LEFT JOIN j ON d.r = j.r GROUP BY d.r, d.doc_id
"""

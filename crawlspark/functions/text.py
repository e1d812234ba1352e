"""Text, status and error classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Java's \s is ASCII only.
SPACE = "[\\t\\n\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def normalize_title(x: Column) -> Column:
    return F.lower(collapse_spaces(x))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ascii_ci(x: Column, text: str) -> Column:
    """Substring search in which A-Z and a-z are alike and no character is a wildcard."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return F.contains(ascii_lower(x), F.lit(lowered))


def truncate(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def in_class(hundreds: int) -> Column:
    return F.col("status").between(hundreds * 100, hundreds * 100 + 99)


def is_failed() -> Column:
    """No response, though a request was made."""
    return (F.col("status") == 0) & ~F.col("blocked")


def is_broken() -> Column:
    return (F.col("status") >= 400) | is_failed()


def has_response() -> Column:
    return F.col("status") > 0


def status_key() -> Column:
    return F.when(has_response(), F.col("status").cast("string")).when(F.col("blocked"), "BLOQ").otherwise("ERR")


def code_label(status: Column, error: Column) -> Column:
    """The label where only an error text tells failed from blocked."""
    return F.when(status > 0, status.cast("string")).when(error != "", "ERR").otherwise("BLOQ")


#: Kinds of errors and the texts that tell them, first match wins.
ERROR_KINDS = (
    ("timeout", ("Client.Timeout", "deadline exceeded")),
    ("conexión rechazada", ("connection refused",)),
    ("tls", ("tls:", "x509")),
    ("conexión cerrada", ("EOF", "reset by peer")),
    ("dns", ("no such host",)),
    ("cuerpo", ("truncated", "body")),
)


def error_kind(error: Column, url: Column) -> Column:
    out = F.when(error.startswith("robots.txt:"), "robots.txt")
    for kind, marks in ERROR_KINDS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(error, F.lit(m))
        out = out.when(hit, kind)
    rest = F.when(url == "", error).otherwise(F.replace(error, url, F.lit("")))
    return out.otherwise(F.concat(F.lit("otro: "), truncate(collapse_spaces(rest), 60)))


def media_type(x: Column) -> Column:
    return F.lower(F.trim(F.split_part(x, F.lit(";"), F.lit(1))))


def has_token(x: Column, token: str) -> Column:
    return F.array_contains(F.split(F.lower(x), "\\s+"), token.lower())


def directives(value: Column, token: str) -> tuple[Column, Column]:
    """noindex and nofollow of a robots directive list; `agent: directive` counts for * and agents that contain token."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(F.lower(x)))
    colon = lambda x: F.locate(":", x)
    agent = lambda x: F.trim(F.substring_index(x, ":", 1))
    ours = F.filter(parts, lambda x: (x != "") & ((colon(x) == 0) | (agent(x) == "*") | F.contains(agent(x), F.lit(token.strip().lower()))))
    names = F.transform(ours, lambda x: F.when(colon(x) == 0, x).otherwise(F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    return F.exists(names, lambda x: x.isin("noindex", "none")), F.exists(names, lambda x: x.isin("nofollow", "none"))


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def grouped(n: int) -> str:
    """A number with `.` between thousands; four digits stay together."""
    return str(n) if abs(n) < 10_000 else f"{n:,}".replace(",", ".")


def grouped_label(n: Column) -> Column:
    return F.when(F.abs(n) < 10_000, n.cast("string")).otherwise(thousands(n))


def _tenths(t: Column) -> Column:
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def bytes_label(n: Column) -> Column:
    """`512 B`, `1.5 kB` or `2.0 MB`, a dash for what is missing or negative. Halves are rounded up."""
    tenths = lambda unit: _tenths(F.floor((n * 10 + unit // 2) / unit))
    return F.when(n.isNull() | (n < 0), "—").when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1 << 20, F.concat(tenths(1 << 10), F.lit(" kB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))


def millis_label(n: Column) -> Column:
    """`250 ms`, `1.5 s` or `2 min 5 s`, a dash for what is missing or negative."""
    seconds = F.concat(_tenths(F.floor((n + 50) / 100)), F.lit(" s"))
    minutes = F.concat(F.floor(n / 60_000), F.lit(" min "), F.floor((n % 60_000 + 500) / 1000), F.lit(" s"))
    return F.when(n.isNull() | (n < 0), "—").when(n < 1000, F.concat(n, F.lit(" ms"))).when(n < 60_000, seconds).otherwise(minutes)


#: Fixed labels of a crawl's state.
STATES = {"running": "en curso", "done": "terminado", "failed": "fallido", "cancelled": "cancelado"}


def state_label(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    return F.coalesce(F.element_at(known, status), F.nullif(status, F.lit("")), F.lit("desconocido"))


def date_label(t: Column) -> Column:
    """Day, month, year and time in two digits each, a dash for none."""
    return F.coalesce(F.date_format(t, "dd/MM/yy, HH:mm"), F.lit("—"))


def yes_no(x: Column) -> Column:
    return F.when(x, "sí").otherwise("no")


def md_cell(x: Column) -> Column:
    return F.replace(F.translate(x, "\n\r", "  "), F.lit("|"), F.lit("\\|"))


def int_avg(total: Column, n: Column) -> Column:
    """Whole-number average, 0 of nothing."""
    return F.coalesce(F.call_function("div", total.cast("long"), F.nullif(n.cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"))

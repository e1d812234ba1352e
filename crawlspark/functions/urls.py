"""Parts and classes of URLs as Column expressions, by the generic URI grammar of RFC 3986, appendix B."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI = "^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)([?]([^#]*))?(#(.*))?"

NO_LANGUAGE = "(sin idioma)"
ROOT_SECTION = "(raíz)"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def authority(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^[^@]*@", ""), ":[0-9]*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), "^www[.]", "")


def path_query(url: Column) -> Column:
    q = query(url)
    return F.when(q == "", path(url)).otherwise(F.concat(path(url), F.lit("?"), q))


def robots_path(url: Column) -> Column:
    """What a robots rule is matched with."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(query(url) == "", p).otherwise(F.concat(p, F.lit("?"), query(url)))


def segments(url: Column) -> Column:
    """Non-empty, percent-decoded path segments; what cannot be decoded stays."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def has_language(segs: Column) -> Column:
    return F.coalesce(F.get(segs, F.lit(0)).rlike("^[A-Za-z]{2}$"), F.lit(False))


def language(segs: Column) -> Column:
    return F.when(has_language(segs), F.lower(F.get(segs, F.lit(0)))).otherwise(NO_LANGUAGE)


def section(segs: Column) -> Column:
    return F.coalesce(F.get(segs, F.when(has_language(segs), 1).otherwise(0)), F.lit(ROOT_SECTION))


def same_site(seed_host: str, h: Column, subdomains: bool) -> Column:
    site = seed_host.lower().removeprefix("www.")
    h = F.regexp_replace(F.lower(h), "^www[.]", "")
    return (h == site) | h.endswith("." + site) if subdomains and site else h == site


def redirect_pattern(source: Column, target: Column) -> Column:
    """The shape of a redirect; the first that fits of a fixed list."""
    f, t = path_query(source), path_query(target)
    a, b = segments(source), segments(target)
    n = F.size(a)
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) != F.get(b, i))
    at = F.get(differ, F.lit(0))
    one = F.concat(F.lit("segmento "), (at + 1).cast("string"), F.lit(": "), F.get(a, at), F.lit(" → "), F.get(b, at))
    same_query = query(source) == query(target)
    return (
        F.when(bare_host(source) != bare_host(target), "otro host")
        .when(t == F.concat(f, F.lit("/")), "añade barra final")
        .when(f == F.concat(t, F.lit("/")), "quita barra final")
        .when((scheme(source) == "http") & (scheme(target) == "https") & (f == t), "http→https")
        .when((f != t) & (F.lower(f) == F.lower(t)), "cambia mayúsculas")
        .when((query(source) != "") & (query(target) == "") & (path(source) == path(target)), "quita query")
        .when(same_query & (n == F.size(b)) & (F.size(differ) == 1), one)
        .when(same_query & (F.size(b) == n + 1) & (F.slice(b, 2, F.greatest(n, F.lit(1))) == a), F.concat(F.lit("añade prefijo /"), F.get(b, F.lit(0))))
        .otherwise("otra ruta")
    )

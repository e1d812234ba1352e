"""URL normalisation. The only URL function that is Python: removing dot segments is iterative."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_URI = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*$")
_CLEAN = re.compile(r"^(?:[A-Za-z0-9._~!$&'()*+,;=:@\[\]/-]|%[0-9A-Fa-f]{2})*$")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_HOST = re.compile(r"^(\[[0-9A-Fa-f:.%]+\]|[^\s:\[\]<>\"\\^`{}|]*)(?::([0-9]*))?$")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
DEFAULT_PORTS = {"http": "80", "https": "443"}


class InvalidURL(ValueError):
    pass


@lru_cache(maxsize=1 << 12)  # a page's own URL is split for each of its links
def split(url: str) -> tuple[str, str | None, str, str | None]:
    """scheme, authority (None if there is none), path, query (None if there is none)."""
    if _CONTROL.search(url):
        raise InvalidURL("control character")
    scheme, authority, path, query, _ = _URI.match(url).groups()
    if scheme is not None and not _SCHEME.match(scheme):
        raise InvalidURL("bad scheme")
    if _BAD_ESCAPE.search(path):
        raise InvalidURL("bad escape")
    return (scheme or "").lower(), authority, path, query


def encoded_path(path: str) -> str:
    return path if _CLEAN.match(path) else quote(unquote_to_bytes(path), safe="/$&+,:;=@-_.~")


def without_dots(path: str) -> str:
    """RFC 3986, 5.2.4, for an absolute path."""
    if "/." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "..":
            if out:
                out.pop()
        elif p != ".":
            out.append(p)
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


def normalize(raw: str, base: str | None = None) -> str:
    """The normal form of raw, resolved against base; InvalidURL if it has none."""
    text = raw.strip()
    if not text:
        raise InvalidURL("empty URL")
    scheme, authority, path, query = split(text)
    if not scheme:
        if base is None:
            raise InvalidURL("relative URL without a base")
        scheme, b_authority, b_path, b_query = split(base)
        if authority is None:
            authority = b_authority
            if not path:
                path, query = b_path, b_query if query is None else query
            elif not path.startswith("/"):
                path = (b_path or "/").rpartition("/")[0] + "/" + path
    if scheme not in DEFAULT_PORTS:
        raise InvalidURL(f"unsupported scheme {scheme}")
    if authority is None or not (m := _HOST.match(authority.rpartition("@")[2])) or not m[1]:
        raise InvalidURL("missing or bad host")
    if "@" in authority:
        raise InvalidURL("userinfo")
    host, port = m[1].lower(), m[2]
    if port and port != DEFAULT_PORTS[scheme]:
        host += ":" + port
    path = encoded_path(path)
    path = without_dots(path if path.startswith("/") else "/" + path)
    return f"{scheme}://{host}{path}" + (f"?{query}" if query else "")


def try_normalize(raw: str | None, base: str | None = None) -> str | None:
    try:
        return None if raw is None else normalize(raw, base)
    except InvalidURL:
        return None


def host_of(url: str) -> str:
    authority = split(url)[1] or ""
    return _HOST.match(authority.rpartition("@")[2])[1].lower()


def same_site(seed_host: str, host: str, subdomains: bool) -> bool:
    s, h = (x.lower().removeprefix("www.") for x in (seed_host, host))
    return s == h or bool(subdomains and s and h.endswith("." + s))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """The normal form as a Column, null where there is none."""

    @F.pandas_udf("string")
    def run(raw: pd.Series, against: pd.Series) -> pd.Series:
        return pd.Series([try_normalize(a, b) for a, b in zip(raw, against)])

    return run(url, F.lit(None).cast("string") if base is None else base)

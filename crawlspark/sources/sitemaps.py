"""Sitemaps: indexes of indexes, gzip, and the page URLs they list."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
import zlib

MOST_URLS, MOST_LEVELS = 10_000, 2


def unpacked(body: bytes, url: str) -> bytes | None:
    """The XML of a sitemap that may be gzipped; None if it is broken."""
    if not body.startswith(b"\x1f\x8b") and not url.lower().endswith(".gz"):
        return body
    try:
        return gzip.decompress(body)
    except (OSError, EOFError, zlib.error):
        return None


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def read_sitemap(body: bytes) -> tuple[list[str], list[str]]:
    """The sitemaps and the pages that a document lists, in order; empty ones stay."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return [], []
    kind, entry = _local(root), {"sitemapindex": "sitemap", "urlset": "url"}.get(_local(root))
    found = [next(((x.text or "").strip() for x in e if _local(x) == "loc"), "") for e in root if _local(e) == entry]
    return (found, []) if kind == "sitemapindex" else ([], found if kind == "urlset" else [])

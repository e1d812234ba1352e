"""Fixed schemas. Absent strings are '' and never null; only finished_at may be null."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in columns.split(","))])


CONFIG = "seed string, max_pages long, max_depth long, concurrency long, delay_ms long, timeout_ms long, max_body_bytes long, user_agent string, include_subdomains boolean, ignore_robots boolean, use_sitemaps boolean, headers map<string,string>, origin string, insecure_tls boolean, follow_nofollow boolean"

CRAWLS = _struct("id long, seed string, status string, config string, started_at timestamp, finished_at timestamp, error string, robots_txt string, pages_version int, links_version int, cleared long")

#: What later versions added, with what older rows have: read as if always there.
ADDED = {"crawls": {"robots_txt": "", "pages_version": 0, "links_version": 0, "cleared": 0}, "pages": {"x_robots_tag": "", "via_nofollow": False}}

PAGES = _struct(
    "id long, crawl_id long, url string, depth int, status int, content_type string, size long, duration_ms long, title string, description string, canonical string,"
    " meta_robots string, x_robots_tag string, h1 string, redirect_to string, error string, noindex boolean, nofollow boolean, via_nofollow boolean, blocked boolean, fetched_at timestamp"
)

LINKS = _struct("id long, crawl_id long, from_page_id long, to_url string, text string, nofollow boolean, in_scope boolean")

#: What a fetch returns; fetch_error is '' for any HTTP answer.
RESPONSES = _struct("url string, status int, content_type string, location string, x_robots_tag string, body binary, truncated boolean, size long, duration_ms long, fetch_error string")

#: A crawled page with its links, before it has an id.
CRAWLED = _struct(
    "seq long, url string, depth int, status int, content_type string, size long, duration_ms long, title string, description string, canonical string, meta_robots string,"
    " x_robots_tag string, h1 string, redirect_to string, error string, noindex boolean, nofollow boolean, via_nofollow boolean, blocked boolean, fetched_at timestamp"
).add("links", T.ArrayType(_struct("url string, text string, nofollow boolean, in_scope boolean")))

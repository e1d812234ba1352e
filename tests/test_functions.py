import pytest
from pyspark.sql import functions as F

from crawlspark.config import Config, split_origin
from crawlspark.functions import html, robots, text, urls
from crawlspark.functions.normalize import InvalidURL, normalize, same_site, without_dots
from crawlspark.plans import report as plan
from crawlspark.sources.sitemaps import read_sitemap, unpacked


@pytest.mark.parametrize(
    "raw, base, expected",
    [
        ("HTTP://Site.TEST:80/a", None, "http://site.test/a"),
        ("https://site.test:443", None, "https://site.test/"),
        ("https://site.test:8443/x#top", None, "https://site.test:8443/x"),
        ("https://site.test/a/../b/./c", None, "https://site.test/b/c"),
        ("../up?q=1", "https://site.test/a/b/c", "https://site.test/a/up?q=1"),
        ("?only=query", "https://site.test/a/b", "https://site.test/a/b?only=query"),
        ("//other.test/x", "https://site.test/", "https://other.test/x"),
        ("https://site.test/ñ", None, "https://site.test/%C3%B1"),
        ("https://site.test/x?", None, "https://site.test/x"),
        ("  https://site.test/x  ", None, "https://site.test/x"),
    ],
)
def test_normalize(raw, base, expected):
    assert normalize(raw, base) == expected


@pytest.mark.parametrize("raw", ["", "/relative", "ftp://site.test/", "mailto:a@b", "https://user:pw@site.test/", "https:///x", "https://site.test/%zz"])
def test_normalize_rejects(raw):
    with pytest.raises(InvalidURL):
        normalize(raw)


def test_without_dots():
    assert without_dots("/a/b/../../../c") == "/c"
    assert without_dots("/a/..") == "/"
    assert without_dots("/a/.") == "/a/"


def test_same_site():
    assert same_site("www.site.test", "SITE.test", False)
    assert not same_site("site.test", "blog.site.test", False)
    assert same_site("site.test", "blog.site.test", True)
    assert not same_site("site.test", "notsite.test", True)


ROBOTS = """
User-agent: *
Disallow: /private   # comment
Allow: /private/open
Disallow: /*.pdf$
Crawl-delay: 2.5
Sitemap: https://site.test/sitemap.xml

User-agent: crawlspark-images
User-agent: other
Disallow: /
"""


def test_robots():
    r = robots.parse_robots(ROBOTS)
    assert not r.allowed("bot", "/private/x")
    assert r.allowed("bot", "/private/open/x")
    assert not r.allowed("bot", "/a/b.pdf")
    assert r.allowed("bot", "/a/b.pdf?x")
    assert r.crawl_delay("bot") == 2.5
    assert r.sitemaps == ["https://site.test/sitemap.xml"]
    assert not r.allowed("crawlspark", "/anything")  # an agent that contains the token
    assert robots.Robots(disallow_all=True, reason="x").allowed("bot", "/") is False
    assert robots.parse_robots("").allowed("bot", "/")
    tie = robots.parse_robots("user-agent: *\ndisallow: /a\nallow: /a")
    assert tie.allowed("bot", "/a")


@pytest.mark.parametrize("value, token, expected", [("noindex", "", (True, False)), ("NONE", "", (True, True)), ("bot: noindex", "bot", (True, False)), ("other: noindex", "bot", (False, False)), ("*: nofollow", "bot", (False, True)), ("noindex nofollow", "", (False, False)), ("", "x", (False, False))])
def test_directives_agree(spark, value, token, expected):
    assert robots.directives(value, token) == expected
    a, b = text.directives(F.lit(value), token)
    assert tuple(spark.range(1).select(a, b).first()) == expected


PAGE = """<html><head><base href="/dir/"><title> A
 title </title><meta name="Robots" content="noindex"><meta name=description content=" d ">
<link rel="x canonical" href="c?x=1"></head><body><h1>One <b>two</b></h1><h1>Three</h1>
<a href="p1">first <i>link</i></a><a href="/dir/p1">again</a><a href="#x">no</a><a href="mailto:x@y">no</a>
<a rel="noopener NoFollow" href="https://other.test/">out<a href="p2">open</body>"""


def test_html():
    p = html.parse_html(PAGE, "https://site.test/page", "site.test", False)
    assert (p["title"], p["h1"], p["description"], p["canonical"]) == ("A title", "One two", "d", "https://site.test/dir/c?x=1")
    assert p["noindex"] and not p["nofollow"]
    assert [(x["url"], x["text"], x["nofollow"], x["in_scope"]) for x in p["links"]] == [
        ("https://site.test/dir/p1", "first link", False, True),
        ("https://other.test/", "out", True, False),
        ("https://site.test/dir/p2", "open", False, True),
    ]


REDIRECTS = [
    ("https://s.test/a", "https://t.test/a", "otro host"),
    ("https://s.test/a", "https://s.test/a/", "añade barra final"),
    ("https://s.test/a/", "https://s.test/a", "quita barra final"),
    ("http://s.test/a", "https://s.test/a", "http→https"),
    ("https://s.test/A", "https://s.test/a", "cambia mayúsculas"),
    ("https://s.test/a?x=1", "https://s.test/a", "quita query"),
    ("https://s.test/es/a", "https://s.test/en/a", "segmento 1: es → en"),
    ("https://s.test/", "https://s.test/en", "añade prefijo /en"),
    ("https://s.test/a/b", "https://s.test/en/a/b", "añade prefijo /en"),
    ("https://s.test/a/b", "https://s.test/c", "otra ruta"),
    ("https://s.test/a", "https://www.s.test/a", "otra ruta"),
]


def test_redirect_patterns(spark):
    df = spark.createDataFrame(REDIRECTS, "f string, t string, want string")
    got = df.select("want", urls.redirect_pattern(F.col("f"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_language_and_section(spark):
    rows = [("https://s.test/", "(sin idioma)", "(raíz)"), ("https://s.test/EN", "en", "(raíz)"), ("https://s.test/es/w%C3%B6r/x", "es", "wör"), ("https://s.test/a+b/c", "(sin idioma)", "a+b"), ("https://s.test/%zz", "(sin idioma)", "%zz")]
    segs = urls.segments(F.col("u"))
    got = spark.createDataFrame(rows, "u string, l string, s string").select(urls.language(segs), urls.section(segs)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_error_kinds(spark):
    rows = [("robots.txt: HTTP 503", "robots.txt"), ("Client.Timeout exceeded", "timeout"), ("connection refused", "conexión rechazada"), ("tls: bad", "tls"), ("read: connection reset by peer", "conexión cerrada"), ("no such host", "dns"), ("body too long", "cuerpo"), ('Get "https://u.test/":  odd ' + "x" * 80, 'otro: Get "": odd ' + "x" * 48)]
    got = spark.createDataFrame(rows, "e string, k string").select(text.error_kind(F.col("e"), F.lit("https://u.test/"))).collect()
    assert [r[0] for r in got] == [k for _, k in rows]


def test_config():
    assert Config(seed="https://s.test/").validate() == []
    bad = Config(seed="x", max_pages=0, max_depth=-1, concurrency=0, delay_ms=-1, headers={"a b": "x", "ok": "a\nb"}, origin="nope")
    assert len(bad.validate()) == 8
    assert Config.from_json('{"seed": "https://s.test/", "delay_ms": 0}').delay_ms == 0
    assert Config.from_json('{"seed": "https://s.test/"}').delay_ms == 500
    assert Config.from_json(Config(seed="https://s.test/", use_sitemaps=False).to_json()).use_sitemaps is False
    assert split_origin("[::1]:8443") == ("::1", "8443") and split_origin("10.0.0.1") == ("10.0.0.1", "")
    for x in ("10.0.0.1:0", "host", "10.0.0.1:99999", "::1:80:"):
        with pytest.raises(ValueError):
            split_origin(x)


def test_sitemaps():
    import gzip

    index = b'<sitemapindex xmlns="x"><sitemap><loc>https://s.test/a.xml</loc></sitemap></sitemapindex>'
    assert read_sitemap(index) == (["https://s.test/a.xml"], [])
    assert read_sitemap(unpacked(gzip.compress(b"<urlset><url><loc>u</loc></url><url/></urlset>"), "x")) == ([], ["u", ""])
    assert read_sitemap(b"junk") == ([], []) and unpacked(b"x", "a.gz") is None


def test_formats():
    assert [plan.thousands(n) for n in (0, 999, 1000, 1234567, -1000)] == ["0", "999", "1.000", "1.234.567", "-1.000"]
    assert [plan.duration_text(x) for x in (0, 500, 15000, 1_800_000, 3_661_000, 1500)] == ["0s", "500ms", "15s", "30m0s", "1h1m1s", "1.5s"]
    assert plan.cell("a|b\nc") == "a\\|b c"
    assert plan.config_line("nonsense") == "(no disponible)"

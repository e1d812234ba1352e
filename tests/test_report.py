"""The report over a made-up library catalogue site, each part against plain Python counts of the same rows."""

from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import report as R
from crawlspark.plans.report import build, to_json, to_markdown

SITE = "https://books.test"
COLUMNS = "id long, crawl_id long, url string, depth int, status int, content_type string, size long, duration_ms long, title string, meta_robots string, redirect_to string, error string, noindex boolean, nofollow boolean, via_nofollow boolean, blocked boolean"
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def shelf(spark):
    """Books by language and shelf; every eighth has moved, every ninth is lost, every eleventh unreachable, every thirteenth closed."""
    rows = []
    for i in range(1, 241):
        lang = ("de", "fr", "")[i % 3]
        path = "/".join(x for x in (lang, f"shelf{i % 5}", f"book{i}") if x)
        kind = "moved" if i % 8 == 0 else "lost" if i % 9 == 0 else "dead" if i % 11 == 0 else "closed" if i % 13 == 0 else "fine"
        status = {"moved": 301, "lost": 404 if i % 2 else 503, "dead": 0, "closed": 0, "fine": 200}[kind]
        to = {0: f"{SITE}/{path}/", 1: f"{SITE}/{path.replace('shelf', 'rack')}"}[i // 8 % 2] if kind == "moved" else ""
        error = ("lookup books.test: no such host", "read: connection reset by peer")[i % 2] if kind == "dead" else ""
        rows.append((i, 1, f"{SITE}/{path}", i % 4, status, "text/html" if kind == "fine" else "", 10 * i if status else 0, (i * 37) % 500 if status else 0, f" Volume {i % 60}  " if kind == "fine" else "", "noindex" if i % 10 == 1 else "", to, error, i % 10 == 1, False, False, kind == "closed"))
    pages = spark.createDataFrame(rows, COLUMNS)
    pairs = [(1 + i % 240, 1 + (i * i) % 240) for i in range(600)]
    links = spark.createDataFrame([(n, 1, a, rows[b - 1][2], "x", False, True) for n, (a, b) in enumerate(pairs)], "id long, crawl_id long, from_page_id long, to_url string, text string, nofollow boolean, in_scope boolean")
    return pages, links, [dict(zip(NAMES, r)) for r in rows], Counter(rows[b - 1][2] for _, b in pairs)


def crawl(**more):
    return {"id": 4, "seed": SITE + "/", "status": "done", "started_at": datetime(2025, 3, 1, 12), "finished_at": datetime(2025, 3, 1, 14, 3, 4), "error": "", "config": '{"max_pages": 1000}'} | more


def key_of(r):
    return str(r["status"]) if r["status"] else "BLOQ" if r["blocked"] else "ERR"


def failed(r):
    return r["status"] == 0 and not r["blocked"]


def average(rows):
    ms = [r["duration_ms"] for r in rows if r["status"]]
    return sum(ms) // len(ms) if ms else 0


def test_parts(spark):
    pages, links, rows, referred = shelf(spark)
    r = build(crawl(), pages, links, now=datetime(2025, 4, 1))
    s = r["summary"]
    assert (s["total"], s["errors"], s["blocked"], s["noindex"], s["max_depth"], s["avg_duration_ms"]) == (240, sum(map(failed, rows)), sum(x["blocked"] for x in rows), 24, 3, average(rows))
    assert [s[f"status_{k}xx"] for k in (2, 3, 4, 5)] == [sum(x["status"] // 100 == k for x in rows) for k in (2, 3, 4, 5)]
    by_status = Counter(map(key_of, rows))
    assert [(x["status"], x["n"]) for x in r["by_status"]] == sorted(by_status.items(), key=lambda x: (-x[1], x[0]))
    for part, key in (("by_depth", lambda x: str(x["depth"])), ("by_language", lambda x: ("de", "fr", "(sin idioma)")[x["id"] % 3])):
        groups = defaultdict(list)
        for x in rows:
            groups[key(x)].append(x)
        assert {b["key"]: (b["total"], b["errors"], b["avg_ms"]) for b in r[part]} == {k: (len(g), sum(map(failed, g)), average(g)) for k, g in groups.items()}
    assert sorted((b["key"], b["total"]) for b in r["by_section"]) == [(f"shelf{k}", 48) for k in range(5)]
    moved = [x for x in rows if x["redirect_to"]]
    slash = [x for x in moved if x["redirect_to"].endswith("/")]
    assert sum(x["n"] for x in r["redirects"]) == len(moved)
    assert next(x for x in r["redirects"] if x["pattern"] == "añade barra final") == {"pattern": "añade barra final", "n": len(slash), "sample_from": slash[0]["url"], "sample_to": slash[0]["redirect_to"]}
    assert all("→" in x["pattern"] and "shelf" in x["pattern"] and "rack" in x["pattern"] for x in r["redirects"] if x["pattern"] != "añade barra final")
    assert {x["n"] for x in r["errors"]} == {sum(failed(x) and x["id"] % 2 == k for x in rows) for k in (0, 1)}
    titles = defaultdict(list)
    for x in rows:
        if x["title"]:
            titles[" ".join(x["title"].split())].append(x)
    twice = sorted(((t, len(g), g[1]["url"]) for t, g in titles.items() if len(g) > 1), key=lambda x: (-x[1], x[0]))[:20]
    assert [(x["title"], x["n"], x["sample_url"]) for x in r["duplicate_titles"]] == twice and len(twice) == 20
    broken = [x for x in rows if x["status"] >= 400 or failed(x)]
    assert r["top_broken_scanned"] == len(broken)
    assert [(x["url"], x["referrers_count"]) for x in r["top_broken"]] == sorted(((x["url"], referred[x["url"]]) for x in broken), key=lambda x: (-x[1], x[0]))[:20]
    for part, by in (("slowest", "duration_ms"), ("largest", "size")):
        assert [x["url"] for x in r[part]] == [x["url"] for x in sorted((x for x in rows if x["status"]), key=lambda x: (-x[by], x["url"]))][:10]
    in_class = {"3xx": moved, "4xx": [x for x in rows if x["status"] == 404], "5xx": [x for x in rows if x["status"] == 503], "error": [x for x in rows if failed(x)], "blocked": [x for x in rows if x["blocked"]], "noindex": [x for x in rows if x["noindex"]]}
    assert {k: len(v) for k, v in r["samples"].items()} == {k: min(10, len(v)) for k, v in in_class.items()}
    assert all({x["url"] for x in v} <= {x["url"] for x in in_class[k]} for k, v in r["samples"].items())
    again = build(crawl(), pages, links, now=datetime(2025, 4, 1))
    assert again["samples"] == r["samples"] != build(crawl(), pages, links, seed=5)["samples"]
    assert to_markdown(again) == to_markdown(r) and to_json(again) == to_json(r)


def test_markdown(spark):
    pages, links, rows, _ = shelf(spark)
    text = to_markdown(build(crawl(), pages, links, now=datetime(2025, 4, 1, 1, 2, 3)))
    lines = text.split("\n")
    assert lines[0] == f"# Informe del rastreo #4 — {SITE}/"
    assert lines[2] == "Estado: done · Inicio: 2025-03-01 12:00:00 UTC · Fin: 2025-03-01 14:03:04 UTC · Duración: 2h3m4s"
    assert lines[3] == "Generado: 2025-04-01 01:02:03 UTC" and "máx. páginas 1.000" in lines[4]
    assert len([x for x in lines if x.startswith("## ")]) == 12
    assert f"| 200 | {Counter(map(key_of, rows))['200']} |" in lines
    running = to_markdown(build(crawl(finished_at=None, status="running", error="a|b\nc", config="nonsense"), pages, links))
    assert "Fin: (en curso) · Duración: —" in running and "Configuración: (no disponible)" in running and "Error del rastreo: a\\|b c" in running


def test_sections_beyond_the_cap(spark):
    rows = [(i, 1, f"{SITE}/room{i:03}", 200, i, False, False) for i in range(73)]
    pages = spark.createDataFrame(rows, "id long, crawl_id long, url string, status int, duration_ms long, blocked boolean, noindex boolean")
    got = R.section_buckets(R.classify(pages)).orderBy("rank").collect()
    assert [x.key for x in got[:50]] == [f"room{i:03}" for i in range(50)]
    assert (got[50].key, got[50].total, got[50].avg_ms) == ("(otras 23 secciones)", 23, sum(range(50, 73)) // 23)


def test_nothing_to_report(spark):
    pages, links, _, _ = shelf(spark)
    text = to_markdown(build(crawl(started_at=None, finished_at=None, config=""), pages.limit(0), links.limit(0)))
    assert text.count("Sin datos.") == 12


def test_pages_of_several_crawls_are_refused(spark):
    pages, links, _, _ = shelf(spark)
    with pytest.raises(ValueError):
        build(crawl(), pages.unionByName(pages.withColumn("crawl_id", F.col("crawl_id") + 1)), links)

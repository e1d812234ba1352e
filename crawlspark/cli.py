"""Command line: python -m crawlspark.cli [--store DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __doc__ as about
from .config import Config, parse_header
from .operators.pages import NotFound
from .plans import report as report_plan
from .store import Store, crawl_into, json_line, progress_lines

VERSION = "0.1.0"


def label(row) -> str:
    return str(row["status"]) if row["status"] > 0 else "BLOQ" if row["blocked"] else "ERR"


def aligned(rows: list[list]) -> str:
    widths = [max(len(str(r[i])) for r in rows) for i in range(len(rows[0]))]
    return "".join("  ".join(str(x).ljust(w) for x, w in zip(r, widths)).rstrip() + "\n" for r in rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crawlspark", description=about)
    p.add_argument("--store", default="crawlspark-data")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("seed")
    d = Config()
    for name in ("max_pages", "max_depth", "concurrency", "delay_ms", "timeout_ms", "max_body_bytes"):
        c.add_argument("--" + name.replace("_", "-"), type=int, default=getattr(d, name))
    c.add_argument("--user-agent", default=d.user_agent)
    c.add_argument("--origin", default="")
    c.add_argument("--header", action="append", default=[])
    for name in ("include_subdomains", "ignore_robots", "insecure_tls", "follow_nofollow", "no_sitemaps"):
        c.add_argument("--" + name.replace("_", "-"), action="store_true")
    c.add_argument("--responses", help="Parquet table of responses to crawl instead of the network")
    crawls = sub.add_parser("crawls")
    pages = sub.add_parser("pages")
    pages.add_argument("--status", default="")
    pages.add_argument("-q", default="")
    broken = sub.add_parser("broken")
    broken.add_argument("--referrers", type=int, default=3)
    report = sub.add_parser("report")
    report.add_argument("-o", dest="out")
    for x in (pages, broken, report):
        x.add_argument("id", type=int)
    for x in (c, crawls, pages, broken, report):
        x.add_argument("--json", action="store_true")
    c.add_argument("--quiet", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("--addr", default="127.0.0.1:8080")
    sub.add_parser("version")
    return p


def config_of(a) -> Config:
    names = ("seed", "max_pages", "max_depth", "concurrency", "delay_ms", "timeout_ms", "max_body_bytes", "user_agent", "origin", "include_subdomains", "ignore_robots", "insecure_tls", "follow_nofollow")
    return Config(**{n: getattr(a, n) for n in names}, use_sitemaps=not a.no_sitemaps, headers=dict(map(parse_header, a.header)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """0: done, 1: failed, 2: bad arguments."""
    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
        config = config_of(a) if a.command == "crawl" else None
    except (SystemExit, ValueError) as e:
        return e.code if isinstance(e, SystemExit) and e.code == 0 else 2
    if a.command == "version":
        print(VERSION, file=out)
        return 0
    if config and (errors := config.validate()):
        print("\n".join(errors), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    store = Store(spark, a.store)
    try:
        return _run(a, config, spark, store, out)
    except NotFound as e:
        print(f"no existe: {e}", file=sys.stderr)
        return 1


def _run(a, config, spark, store: Store, out) -> int:
    from .functions.normalize import host_of, normalize
    from .plans.report import thousands
    from .sources.responses import HttpFetcher, TableFetcher

    lines = lambda rows: out.write("".join(json_line(r) + "\n" for r in rows))
    if a.command == "crawl":
        fetcher = TableFetcher(spark.read.parquet(a.responses)) if a.responses else HttpFetcher(config, host_of(normalize(config.seed)))
        crawl_id = crawl_into(store, config, fetcher, None if a.quiet else progress_lines(sys.stderr))
        s = store.summarize(crawl_id)
        if a.json:
            lines([{"id": crawl_id, "summary": s}])
        else:
            out.write(aligned([["crawl", crawl_id], *([k, thousands(v) if isinstance(v, int) else v] for k, v in s.items() if k != "content_types")]))
    elif a.command == "serve":
        from .manager import Api, Manager, serve

        manager = Manager(store, lambda c: HttpFetcher(c, host_of(normalize(c.seed))))
        host, _, port = a.addr.rpartition(":")
        server = serve(Api(store, manager), host or "127.0.0.1", int(port))
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
            manager.shutdown()
    elif a.command == "crawls":
        rows = [r.asDict() for r in store.list_crawls().collect()]
        lines(rows) if a.json else out.write(aligned([["ID", "ESTADO", "INICIO", "SEMILLA"], *([r["id"], r["status"], r["started_at"], r["seed"]] for r in rows)]))
    elif a.command == "pages":
        rows = [r.asDict() for r in store.list_pages(a.id, a.status, a.q)[0].collect()]
        lines(rows) if a.json else out.write(aligned([["CÓDIGO", "PROF", "VÍA", "URL", "TÍTULO"], *([label(r), r["depth"], "nofollow" if r["via_nofollow"] else "", r["url"], r["title"]] for r in rows)]))
    elif a.command == "broken":
        from .operators.pages import broken_with_referrers

        store.get_crawl(a.id)
        found = broken_with_referrers(store.pages(a.id), store.links(a.id), a.referrers).orderBy("url")
        for r in (x.asDict() for x in found.toLocalIterator(prefetchPartitions=True)):  # written as they come
            if a.json:
                lines([r])
            else:
                out.write(f"{label(r)}  {r['url']}  ({r['referrers_count']})\n" + "".join(f"    {u}\n" for u in r["referrers"]))
    else:
        r = store.report(a.id)
        text = report_plan.to_json(r) + "\n" if a.json else report_plan.to_markdown(r)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            out.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

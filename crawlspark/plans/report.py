"""The whole report of a crawl: small aggregates collected into one document, and its Markdown."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import report as R


def build(crawl: dict, pages: DataFrame, links: DataFrame, seed: int = 0, now: datetime | None = None) -> dict:
    """The report of one crawl, whose pages and links are given; ValueError if they are of several. Every list is bounded but those by depth, status and language.

    All that is counted by a key comes from one pass with grouping sets, whose few rows are
    kept; the others read the classified pages, which are kept, too.
    """
    prepared = R.classify(pages).persist()
    counts = R.all_counts(prepared).persist()
    by = lambda part: R.averaged(counts.where(F.col("part") == part).drop("part", "via_nofollow", "broken", "max_depth"))
    rows = lambda df, *order: lambda: [r.asDict(recursive=True) for r in df.orderBy(*order).drop("crawl_id").collect()]
    ranked = lambda df: rows(df, "rank")
    parts = {
        "summary": lambda: _summary(counts),
        "by_depth": rows(by("depth"), F.col("key").cast("int")),
        "by_status": rows(by("status_key").select("crawl_id", F.col("key").alias("status"), F.col("total").alias("n")), F.desc("n"), "status"),
        "by_language": rows(by("language"), F.desc("total"), "key"),
        "by_section": ranked(R.ranked_sections(counts.where("part = 'section'"))),
        "content_types": rows(by("content_type").where("key <> ''").select("crawl_id", F.col("key").alias("content_type"), F.col("total").alias("n")), "content_type"),
        "redirects": rows(R.redirects(prepared).orderBy(F.desc("n"), "pattern").limit(R.REDIRECTS), F.desc("n"), "pattern"),
        "errors": rows(R.errors(prepared).orderBy(F.desc("n"), "kind").limit(R.ERRORS), F.desc("n"), "kind"),
        "top_broken": ranked(R.top_broken(prepared, links, one_crawl=True)),
        "duplicate_titles": rows(R.duplicate_titles(prepared).orderBy(F.desc("n"), "title").limit(R.TITLES), F.desc("n"), "title"),
        "slowest": ranked(R.top_pages(prepared, "duration_ms")),
        "largest": ranked(R.top_pages(prepared, "size")),
        "samples": rows(R.samples(prepared, seed), "key", "rn"),
    }
    try:
        counts.count()  # once, before the parts share it
        if counts.where("part = 'all'").count() > 1:
            raise ValueError("pages of several crawls")
        with ThreadPoolExecutor(8) as pool:
            got = dict(zip(parts, pool.map(lambda f: f(), parts.values())))
    finally:
        counts.unpersist()
        prepared.unpersist()
    got["summary"], n_broken = got["summary"]
    got["top_broken_scanned"] = min(R.SCANNED, n_broken)
    samples: dict[str, list] = {}
    for r in got.pop("samples"):
        samples.setdefault(r["key"], []).append({k: v for k, v in r.items() if k not in ("key", "rn")})
    for name in ("by_section", "top_broken", "slowest", "largest"):
        got[name] = [{k: v for k, v in r.items() if k != "rank"} for r in got[name]]
    got["content_types"] = {r["content_type"]: r["n"] for r in got["content_types"]}
    return {"generated_at": now or datetime.now(timezone.utc), "crawl": crawl, **got, "samples": samples}


def _summary(counts: DataFrame) -> tuple[dict, int]:
    """The counters of all pages, and how many are broken."""
    row = R.averaged(counts.where("part = 'all'")).first()
    names = ("total", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "errors", "blocked", "noindex", "via_nofollow", "max_depth")
    got = {n: row[n] if row else 0 for n in names} | {"avg_duration_ms": row["avg_ms"] if row else 0}
    return got, row["broken"] if row else 0


def to_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, default=lambda x: x.isoformat())


def thousands(n: int) -> str:
    return f"{n:,}".replace(",", ".")


def cell(text) -> str:
    return str(text).replace("\n", " ").replace("\r", " ").replace("|", "\\|")


def duration_text(ms: int) -> str:
    """A length of time as hours, minutes and seconds with units; below a second in milliseconds."""
    if ms == 0:
        return "0s"
    sign, ms = ("-" if ms < 0 else ""), abs(ms)
    if ms < 1000:
        return f"{sign}{ms}ms"
    minutes, rest = divmod(ms, 60_000)
    hours, minutes = divmod(minutes, 60)
    seconds = f"{rest / 1000:.3f}".rstrip("0").rstrip(".") + "s"
    return sign + (f"{hours}h{minutes}m" if hours else f"{minutes}m" if minutes else "") + seconds


def time_text(t: datetime | None, absent: str = "—") -> str:
    return absent if t is None else t.strftime("%Y-%m-%d %H:%M:%S UTC")


def config_line(text: str) -> str:
    try:
        c = json.loads(text)
        yes = lambda x: "sí" if x else "no"
        parts = [f"máx. páginas {thousands(c.get('max_pages', 0))}", f"máx. profundidad {thousands(c.get('max_depth', 0))}", f"concurrencia {thousands(c.get('concurrency', 0))}"]
        if c.get("delay_ms") is not None:
            parts.append(f"retardo {duration_text(c['delay_ms'])}")
        if c.get("timeout_ms", 0) > 0:
            parts.append(f"timeout {duration_text(c['timeout_ms'])}")
        parts += [f"subdominios: {yes(c.get('include_subdomains'))}", f"robots: {yes(not c.get('ignore_robots'))}"]
        if c.get("use_sitemaps") is not None:
            parts.append(f"sitemaps: {yes(c['use_sitemaps'])}")
        if c.get("user_agent"):
            parts.append(f"UA: {c['user_agent']}")
        return " · ".join(parts)
    except (ValueError, AttributeError, TypeError):
        return "(no disponible)"


def _follows(text: str) -> bool:
    try:
        return bool(json.loads(text).get("follow_nofollow"))
    except (ValueError, AttributeError):
        return False


def code(status: int, error: str) -> str:
    return str(status) if status > 0 else "ERR" if error else "BLOQ"


def table(heads: list[str], rows: list[list]) -> str:
    if not rows:
        return "Sin datos.\n"
    lines = [heads, None, *rows]
    return "".join("|" + "---|" * len(heads) + "\n" if x is None else "|" + "".join(f" {cell(c)} |" for c in x) + "\n" for x in lines)


_BUCKET = ["Páginas", "2xx", "3xx", "4xx", "5xx", "Errores", "Bloq.", "noindex", "Media (ms)"]
_BUCKET_KEYS = ["total", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "errors", "blocked", "noindex", "avg_ms"]
_SAMPLES = {"3xx": "Redirecciones (3xx)", "4xx": "No encontradas (4xx)", "5xx": "Errores de servidor (5xx)", "error": "Fallos de red", "blocked": "Bloqueadas por robots", "noindex": "noindex", "via_nofollow": "Solo vía nofollow"}


def to_markdown(r: dict) -> str:
    """The report as Markdown: the same report gives the same bytes."""
    c, s, n = r["crawl"], r["summary"], thousands
    took = "—"
    if c["finished_at"] and c["started_at"]:
        seconds = round((c["finished_at"] - c["started_at"]).total_seconds())
        took = duration_text(seconds * 1000) if seconds >= 0 else "—"
    out = [
        f"# Informe del rastreo #{c['id']} — {c['seed']}\n\n",
        f"Estado: {c['status']} · Inicio: {time_text(c['started_at'])} · Fin: {time_text(c['finished_at'], '(en curso)')} · Duración: {took}\n",
        f"Generado: {time_text(r['generated_at'])}\nConfiguración: {config_line(c['config'])}\n\n",
    ]
    if c["error"]:
        out.append(f"Error del rastreo: {cell(c['error'])}\n\n")
    keys = [("Páginas", "total"), *((f"{k}xx", f"status_{k}xx") for k in (2, 3, 4, 5)), ("Errores", "errors"), ("Bloqueadas", "blocked"), ("noindex", "noindex")]
    rows = [[label, n(s[k])] for label, k in keys] + [["Solo vía nofollow", n(s["via_nofollow"])]] * _follows(c["config"])
    out.append(table(["Métrica", "Valor"], rows + [["Profundidad máxima", n(s["max_depth"])], ["Tiempo medio de respuesta", n(s["avg_duration_ms"]) + " ms"]]))

    def section(title: str, body: str) -> None:
        out.append(f"\n## {title}\n\n{body}")

    def bucket(rows: list[dict]) -> list[list]:
        return [[b["key"], *(n(b[k]) for k in _BUCKET_KEYS)] for b in rows]

    section("Códigos", table(["Código", "Páginas"], [[x["status"], n(x["n"])] for x in r["by_status"]]))
    for title, head, key in (("Por profundidad", "Profundidad", "by_depth"), ("Por idioma", "Idioma", "by_language"), ("Por sección (top 50)", "Sección", "by_section")):
        section(title, table([head, *_BUCKET], bucket(r[key])))
    section("Tipos de contenido", table(["Tipo", "Páginas"], [[k, n(v)] for k, v in sorted(r["content_types"].items(), key=lambda x: (-x[1], x[0]))]))
    section("Redirecciones", table(["Patrón", "Páginas", "Ejemplo de origen", "Ejemplo de destino"], [[x["pattern"], n(x["n"]), x["sample_from"], x["sample_to"]] for x in r["redirects"]]))
    section("Errores", table(["Tipo", "Páginas", "URL de ejemplo"], [[x["kind"], n(x["n"]), x["sample_url"]] for x in r["errors"]]))
    broken = table(["Referrers", "Código", "URL", "Error"], [[n(x["referrers_count"]), code(x["status"], x["error"]), x["url"], x["error"]] for x in r["top_broken"]])
    section("Páginas rotas con más referrers", (f"Sobre {n(r['top_broken_scanned'])} páginas rotas analizadas.\n\n" if r["top_broken"] else "") + broken)
    section("Títulos duplicados", table(["Páginas", "Título", "URL de ejemplo"], [[n(x["n"]), x["title"], x["sample_url"]] for x in r["duplicate_titles"]]))
    for title, head, key, by in (("Páginas más lentas", "Tiempo (ms)", "slowest", "duration_ms"), ("Páginas más grandes", "Tamaño (bytes)", "largest", "size")):
        section(title, table([head, "Código", "Prof.", "URL"], [[n(x[by]), code(x["status"], x["extra"]), x["depth"], x["url"]] for x in r[key]]))
    parts = [f"### {label}\n\n" + table(["Código", "Prof.", "URL", "Detalle"], [[code(x["status"], x["extra"]), x["depth"], x["url"], x["extra"]] for x in r["samples"][key]]) for key, label in _SAMPLES.items() if r["samples"].get(key)]
    section("Muestras", "\n".join(parts) if parts else "Sin datos.\n")
    return "".join(out)

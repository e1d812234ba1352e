"""Crawls in the background, and the answers of a JSON interface over a store.

Api.handle() is free of any server: it takes a method, a path, parameters and a body and gives
a status, headers and a body. serve() puts it behind the standard library's HTTP server.
"""

from __future__ import annotations

import json
import re
import threading
import time
import traceback
from collections.abc import Callable
from datetime import datetime

from .config import Config
from .operators import pages as P
from .plans import report as report_plan
from .store import NotFound, Store, crawl_into


class Invalid(ValueError):
    """Settings that do not hold; errors lists all messages."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class Manager:
    """start() runs a crawl in a thread; the store is changed by one thread at a time."""

    def __init__(self, store: Store, fetcher_of: Callable[[Config], object]):
        self.store, self.fetcher_of = store, fetcher_of
        self._lock, self._store_lock = threading.Lock(), threading.RLock()
        self._running: dict[int, tuple[threading.Thread, threading.Event]] = {}

    def start(self, config: Config) -> int:
        config = config.with_defaults()
        if errors := config.validate():
            raise Invalid(errors)
        with self._store_lock:
            crawl_id = self.store.create_crawl(config.seed, config.to_json())
        stop = threading.Event()
        thread = threading.Thread(target=self._run, args=(crawl_id, config, stop), daemon=True)
        with self._lock:
            self._running[crawl_id] = thread, stop
        thread.start()
        return crawl_id

    def _run(self, crawl_id: int, config: Config, stop: threading.Event) -> None:
        store = _Locked(self.store, self._store_lock)
        try:
            crawl_into(store, config, self.fetcher_of(config), stopped=stop.is_set, crawl_id=crawl_id)
        except Exception as e:  # noqa: BLE001  crawl_into has stored the failure unless the store itself failed
            with self._store_lock:
                try:
                    self.store.finish_crawl(crawl_id, "failed", str(e))
                except NotFound:
                    pass  # deleted while it ran
        finally:
            with self._lock:
                self._running.pop(crawl_id, None)

    def cancel(self, crawl_id: int) -> bool:
        """Ask a crawl to stop after its round; False if it is not running."""
        with self._lock:
            found = self._running.get(crawl_id)
        if found:
            found[1].set()
        return found is not None

    def running(self) -> list[int]:
        with self._lock:
            return sorted(self._running)

    def is_running(self, crawl_id: int) -> bool:
        return crawl_id in self.running()

    def wait(self, crawl_id: int, seconds: float) -> bool:
        """Whether a crawl has ended within some seconds."""
        with self._lock:
            found = self._running.get(crawl_id)
        if found:
            found[0].join(seconds)
        return not self.is_running(crawl_id)

    def shutdown(self, seconds: float = 60.0) -> bool:
        """Cancel all and wait; whether all have ended in time."""
        end = time.monotonic() + seconds
        ids = self.running()
        for i in ids:
            self.cancel(i)
        return all([self.wait(i, max(0.0, end - time.monotonic())) for i in ids])


class _Locked:
    """A store whose calls wait for each other."""

    def __init__(self, store: Store, lock):
        self._store, self._lock = store, lock

    def __getattr__(self, name):
        found = getattr(self._store, name)
        if not callable(found):
            return found

        def call(*a, **k):
            with self._lock:
                return found(*a, **k)

        return call


def json_body(value) -> str:
    """One line of JSON."""
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.isoformat() if isinstance(x, datetime) else str(x)) + "\n"


def errors_body(errors: list[str]) -> str:
    return json_body({"errors": errors})


def limit_offset(params: dict) -> tuple[int, int]:
    """What a caller asks for, within bounds; what is no number counts as absent."""

    def number(name: str) -> int:
        x = str(params.get(name, ""))
        return int(x) if re.fullmatch(r"[+-]?\d+", x, re.A) else 0

    return P.clamp_limit(number("limit")), max(0, number("offset"))


JSON, MARKDOWN = {"Content-Type": "application/json"}, {"Content-Type": "text/markdown; charset=utf-8"}


class Api:
    def __init__(self, store: Store, manager: Manager):
        self.store, self.manager = store, manager
        i = r"(?P<id>\d+)"
        self.routes = [
            (r"/api/healthz", {"GET": lambda p, b: (200, {"status": "ok"})}),
            (r"/api/crawls", {"GET": self._list, "POST": self._create}),
            (rf"/api/crawls/{i}", {"GET": self._get, "DELETE": self._delete}),
            (rf"/api/crawls/{i}/cancel", {"POST": self._cancel}),
            (rf"/api/crawls/{i}/pages", {"GET": self._pages}),
            (rf"/api/crawls/{i}/pages/(?P<page_id>\d+)", {"GET": self._page}),
            (rf"/api/crawls/{i}/broken", {"GET": self._broken}),
            (rf"/api/crawls/{i}/report", {"GET": self._report}),
        ]

    def handle(self, method: str, path: str, params: dict | None = None, body: str = "") -> tuple[int, dict, str]:
        """Status, headers and body of the answer to a request."""
        for pattern, methods in self.routes:
            if m := re.fullmatch(pattern, path, re.A):
                if method not in methods:
                    return 405, JSON | {"Allow": ", ".join(sorted(methods))}, errors_body(["método no permitido"])
                try:
                    status, value, *headers = methods[method]((params or {}) | {k: int(v) for k, v in m.groupdict().items()}, body)
                except NotFound:
                    return 404, JSON, errors_body(["no encontrado"])
                except Invalid as e:
                    return 400, JSON, errors_body(e.errors)
                except Exception:  # noqa: BLE001  a caller gets an answer; the reason goes to the log
                    traceback.print_exc()
                    return 500, JSON, errors_body(["error interno"])
                if status == 204:
                    return 204, {}, ""
                return status, JSON | (headers[0] if headers else {}), value if isinstance(value, str) else json_body(value)
        return 404, JSON, errors_body(["no encontrado"])

    def _list(self, p, body):
        return 200, {"crawls": [r.asDict() for r in self.store.list_crawls().collect()]}

    def _create(self, p, body):
        try:
            config = Config.from_json(body)
        except (ValueError, TypeError, AttributeError):
            raise Invalid(["json malformado"]) from None
        return 201, self.store.get_crawl(self.manager.start(config))

    def _get(self, p, body):
        running = self.manager.is_running(p["id"])  # asked first: a crawl that no longer runs has its final state stored
        return 200, {"crawl": self.store.get_crawl(p["id"]), "summary": self.store.summarize(p["id"]), "running": running}

    def _cancel(self, p, body):
        crawl = self.store.get_crawl(p["id"])
        self.manager.cancel(p["id"])
        return 200, {"crawl": crawl}

    def _delete(self, p, body):
        self.store.get_crawl(p["id"])
        if self.manager.cancel(p["id"]):
            self.manager.wait(p["id"], 10.0)
        with self.manager._store_lock:
            self.store.delete_crawl(p["id"])
        return 204, ""

    def _pages(self, p, body):
        limit, offset = limit_offset(p)
        try:
            rows, total = self.store.list_pages(p["id"], p.get("status", ""), p.get("q", ""), limit, offset)
        except ValueError:
            raise Invalid(["status no válido"]) from None
        return 200, {"pages": [r.asDict() for r in rows.collect()], "total": total, "limit": limit, "offset": offset}

    def _page(self, p, body):
        return 200, self.store.get_page(p["id"], p["page_id"])

    def _broken(self, p, body):
        limit, offset = limit_offset(p)
        rows = [r.asDict() for r in self.store.broken(p["id"], limit, offset).collect()]
        return 200, {"broken": rows, "total": self.store.totals(p["id"])["broken"], "limit": limit, "offset": offset}

    def _report(self, p, body):
        kind = p.get("format") or "json"
        if kind not in ("json", "md"):
            raise Invalid(["format no válido"])
        r = self.store.report(p["id"])
        extra = {"Content-Disposition": f'attachment; filename="rastreo-{p["id"]}.{kind}"'} if p.get("download") == "1" else {}
        return (200, report_plan.to_markdown(r), MARKDOWN | extra) if kind == "md" else (200, {"report": r}, extra)


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080):
    """An HTTP server for an Api; serve_forever() runs it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            at = urlsplit(self.path)
            n = min(int(self.headers.get("Content-Length") or 0), 1 << 20)
            status, headers, body = api.handle(self.command, at.path, dict(parse_qsl(at.query)), self.rfile.read(n).decode("utf-8", "replace"))
            data = body.encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_PUT = _answer

        def log_message(self, *a):
            pass

    return ThreadingHTTPServer((host, port), Handler)

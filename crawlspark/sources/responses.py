"""Where answers to URLs come from: a table of responses, or HTTP."""

from __future__ import annotations

import math
import time
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, split_origin
from ..functions.normalize import host_of
from ..schema import RESPONSES

MISSING = "no response configured"


class Fetcher(Protocol):
    """fetch() takes (url) and returns RESPONSES, a row per url."""

    def fetch(self, urls: DataFrame) -> DataFrame: ...

    def pace(self, delay_ms: int) -> None:
        """At least so long between the starts of two requests from now on."""


class TableFetcher:
    """Answers from a table; a URL that it lacks fails."""

    def __init__(self, responses: DataFrame):
        names = set(responses.columns)
        self.responses = responses.select(*(F.col(f.name).cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in RESPONSES.fields))

    def pace(self, delay_ms: int) -> None:
        """A table is read at any rate."""

    def fetch_one(self, url: str) -> DataFrame:
        """fetch() of one URL: the table's files are asked for it by their bounds and Bloom filters, instead of being read to meet it."""
        own = self.responses.where(F.col("url") == url)
        return self._answers(self.responses.sparkSession.range(1).select(F.lit(url).alias("url")), own)

    def fetch(self, urls: DataFrame) -> DataFrame:
        r = self.responses.withColumnRenamed("url", "u")
        # first cut to what is asked for: the left join can broadcast only the table, this one the URLs of a small wave
        return self._answers(urls, r.join(urls.select("url"), F.col("url") == F.col("u"), "left_semi").withColumnRenamed("u", "url"))

    @staticmethod
    def _answers(urls: DataFrame, found: DataFrame) -> DataFrame:
        found = found.withColumn("known", F.lit(True)).withColumnRenamed("url", "u")
        joined = urls.select("url").join(found, F.col("url") == F.col("u"), "left")
        error = F.when(F.col("known").isNull(), MISSING).otherwise(F.coalesce("fetch_error", F.lit("")))
        fill = {"status": 0, "content_type": "", "location": "", "x_robots_tag": "", "size": 0, "duration_ms": 0, "truncated": False}
        return joined.withColumn("fetch_error", error).fillna(fill).select(*RESPONSES.fieldNames())


def connection_target(url: str, seed_host: str, origin: str) -> tuple[str, int] | None:
    """The address to dial instead of the URL's host: the origin, for the seed's host and its www twin."""
    host = host_of(url)
    if not origin or host.removeprefix("www.") != seed_host.lower().removeprefix("www."):
        return None
    ip, port = split_origin(origin)
    return ip, int(port or (443 if url.startswith("https:") else 80))


def next_slot(now: float, origin: float, delay: float, worker: int, workers: int, last: int = -1) -> tuple[int, float]:
    """A worker's next turn, later than its turn `last`: number and start.

    Turns of all workers are `delay` apart from `origin` on and belong to them in rotation, so
    the workers keep one rate between them without speaking to each other.
    """
    turn = max(last + 1, math.ceil((now - origin) / delay)) if delay > 0 else last + 1
    turn += (worker - turn) % workers
    return turn, origin + turn * delay


class HttpFetcher:
    """GET requests from the executors; redirects are not followed.

    `concurrency` partitions take turns, so that all requests of a crawl together keep
    `delay_ms` between the starts of two.
    """

    #: About how long the requests of a slice of a round may take before their pages are given out.
    flush_seconds = 30

    def __init__(self, config: Config, seed_host: str):
        self.config, self.seed_host, self.delay_ms, self.called = config, seed_host, config.delay_ms, False

    def pace(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def fetch(self, urls: DataFrame) -> DataFrame:
        config, seed_host, workers, delay = self.config, self.seed_host, self.config.concurrency, self.delay_ms / 1000
        # the requests of the call before have all begun by now
        origin, self.called = time.time() + delay * self.called, True

        def run(batches):
            worker, turn = TaskContext.get().partitionId() % workers, -1
            for batch in batches:
                rows = []
                for url in batch.url:
                    turn, start = next_slot(time.time(), origin, delay, worker, workers, turn)
                    if delay > 0:
                        time.sleep(max(0.0, start - time.time()))
                    rows.append(get(url, config, seed_host))
                yield pd.DataFrame(rows, columns=RESPONSES.fieldNames())

        return urls.select("url").repartition(workers).mapInPandas(run, RESPONSES)


def get(url: str, config: Config, seed_host: str) -> tuple:
    """One request as a row of RESPONSES."""
    import http.client
    import ssl
    from urllib.parse import urlsplit

    began = time.monotonic()
    try:
        parts = urlsplit(url)
        dial = connection_target(url, seed_host, config.origin)
        timeout = config.timeout_ms / 1000
        if parts.scheme == "https":
            context = ssl.create_default_context()
            if config.insecure_tls:
                context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
            client = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=timeout, context=context)
        else:
            client = http.client.HTTPConnection(parts.hostname, parts.port, timeout=timeout)
        if dial:
            client._create_connection = lambda address, *a, **k: __import__("socket").create_connection(dial, *a, **k)
        headers = {"User-Agent": config.user_agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8"} | config.headers
        client.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
        answer = client.getresponse()
        body = answer.read(config.max_body_bytes + 1)
        cut = len(body) > config.max_body_bytes
        body = body[: config.max_body_bytes]
        tags = ", ".join(answer.headers.get_all("X-Robots-Tag") or [])
        client.close()
        return url, answer.status, answer.headers.get("Content-Type", ""), answer.headers.get("Location", ""), tags, body, cut, len(body), int((time.monotonic() - began) * 1000), ""
    except Exception as e:  # noqa: BLE001  a failed request is a row
        return url, 0, "", "", "", b"", False, 0, int((time.monotonic() - began) * 1000), str(e) or type(e).__name__

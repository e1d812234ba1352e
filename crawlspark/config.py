"""Crawl settings: defaults, validation, JSON."""

from __future__ import annotations

import ipaddress
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace

from .functions.normalize import InvalidURL, split

_TOKEN = re.compile(r"^[A-Za-z0-9!#$%&'*+.^_`|~-]+$")


def split_origin(origin: str) -> tuple[str, str]:
    """`ip` or `ip:port` (an IPv6 address with a port in brackets); ValueError for anything else."""
    host, port = origin, ""
    if origin.startswith("[") or origin.count(":") == 1:
        m = re.fullmatch(r"(?:\[([^\]]*)\]|([^:\[\]]*)):([0-9]+)", origin)
        if not m or not 1 <= int(m[3]) <= 65535:
            raise ValueError(origin)
        host, port = m[1] if m[1] is not None else m[2], m[3]
    ipaddress.ip_address(host)
    return host, port


def is_absolute_http(url: str) -> bool:
    try:
        scheme, authority, _, _ = split(url)
    except InvalidURL:
        return False
    return scheme in ("http", "https") and bool(authority)


@dataclass(frozen=True)
class Config:
    seed: str = ""
    max_pages: int = 500
    max_depth: int = 10
    concurrency: int = 4
    delay_ms: int = 500
    timeout_ms: int = 15_000
    max_body_bytes: int = 2 << 20
    user_agent: str = "crawlspark/0.1"
    include_subdomains: bool = False
    ignore_robots: bool = False
    use_sitemaps: bool = True
    headers: dict = field(default_factory=dict)
    origin: str = ""
    insecure_tls: bool = False
    follow_nofollow: bool = False
    robots_token: str = "crawlspark"

    def validate(self) -> list[str]:
        """Every violation, as a message."""
        out, seed = [], self.seed.strip()
        if not seed:
            out.append("la semilla es obligatoria")
        elif not is_absolute_http(seed):
            out.append("la semilla debe ser una URL http o https absoluta")
        for bad, message in (
            (self.max_pages <= 0, "max_pages debe ser mayor que 0"),
            (self.max_depth < 0, "max_depth no puede ser negativo"),
            (self.concurrency <= 0, "concurrency debe ser mayor que 0"),
            (self.delay_ms < 0, "delay_ms no puede ser negativo"),
        ):
            if bad:
                out.append(message)
        for name, value in sorted(self.headers.items()):
            if not _TOKEN.match(name):
                out.append(f"cabecera no válida: {json.dumps(name, ensure_ascii=False)}")
            elif "\r" in value or "\n" in value:
                out.append(f"valor de cabecera no válido: {json.dumps(name, ensure_ascii=False)}")
        if self.origin:
            try:
                split_origin(self.origin)
            except ValueError:
                out.append(f"origin no válido: {json.dumps(self.origin, ensure_ascii=False)}")
        return out

    def with_defaults(self) -> Config:
        """Zero and empty settings replaced; delay and switches are taken as they are."""
        d = Config()
        names = ("max_pages", "max_depth", "concurrency", "timeout_ms", "max_body_bytes", "user_agent", "robots_token")
        return replace(self, **{n: getattr(self, n) or getattr(d, n) for n in names})

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "robots_token"}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Absent settings get defaults; numbers that are 0 do, too, but for delay_ms."""
        doc = {k: v for k, v in json.loads(text).items() if v is not None and k in {f.name for f in fields(cls)}}
        return cls(**doc).with_defaults()


def parse_header(line: str) -> tuple[str, str]:
    """`Name: value`."""
    name, colon, value = line.partition(":")
    if not colon:
        raise ValueError(line)
    return name.strip(), value.strip()

"""Page fields and links of HTML, from the tree that the standard's parser builds."""

from __future__ import annotations

from .html_tree import Node, parse
from .normalize import host_of, same_site, try_normalize
from .robots import directives

_UNUSABLE = ("#", "mailto:", "tel:", "javascript:", "data:")
TEXT_LIMIT = 200


def collapse(text: str) -> str:
    return " ".join(text.split())


def usable(href: str) -> bool:
    return bool(href) and not href.lower().startswith(_UNUSABLE)


def parse_html(body: str, page_url: str, seed_host: str, subdomains: bool) -> dict:
    """title, h1, description, canonical, meta_robots, noindex, nofollow and links (url, text, nofollow, in_scope)."""
    first: dict[str, str] = {}  # title and h1
    metas: dict[str, str] = {}
    bases, canonicals, anchors = [], [], []
    for n in parse(body).walk():
        if not isinstance(n, Node):
            continue
        if n.tag in ("title", "h1"):
            if n.tag not in first:
                first[n.tag] = n.text()
        elif n.tag == "meta":
            metas.setdefault(n.attrs.get("name", "").strip().lower(), n.attrs.get("content", ""))
        elif n.tag == "base":
            bases.append(n.attrs.get("href", "").strip())
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split():
            canonicals.append(n.attrs.get("href", "").strip())
        elif n.tag == "a" and "href" in n.attrs:
            anchors.append(n)
    base = next(filter(None, bases), "")
    base = (try_normalize(base, page_url) if base else None) or page_url
    meta_robots = metas.get("robots", "")
    noindex, nofollow = directives(meta_robots, "")
    links: dict[str, dict] = {}
    for a in anchors:
        href = a.attrs["href"].strip()
        url = try_normalize(href, base) if usable(href) else None
        if url is not None and url not in links:
            links[url] = {"url": url, "text": collapse(a.text())[:TEXT_LIMIT], "nofollow": "nofollow" in a.attrs.get("rel", "").lower().split(), "in_scope": same_site(seed_host, host_of(url), subdomains)}
    return {
        "title": collapse(first.get("title", "")),
        "h1": collapse(first.get("h1", "")),
        "description": metas.get("description", "").strip(),
        "canonical": next((u for c in canonicals if c and (u := try_normalize(c, base))), ""),
        "meta_robots": meta_robots,
        "noindex": noindex,
        "nofollow": nofollow,
        "links": list(links.values()),
    }

"""robots.txt: parsing, group choice, rule matching."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, pattern)
    delay: float | None = None  # seconds


def pattern_regex(pattern: str) -> str:
    """`*` is any text, a final `$` the end; anchored at the start."""
    end = pattern.endswith("$")
    return "^" + ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else "")


@dataclass
class Robots:
    groups: list[Group] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    disallow_all: bool = False
    reason: str = ""

    def group(self, token: str) -> Group | None:
        """The first group with an agent that contains the token, else the first for *; groups are not merged."""
        token = token.lower()
        named = (g for g in self.groups if token and any(a != "*" and token in a for a in g.agents))
        return next(named, None) or next((g for g in self.groups if "*" in g.agents), None)

    def allowed(self, token: str, path: str) -> bool:
        """The longest pattern that matches decides, allow at a tie; none allows."""
        if self.disallow_all:
            return False
        g = self.group(token)
        hits = [(len(p.encode()), allow) for allow, p in g.rules if re.search(pattern_regex(p), path)] if g else []
        return max(hits)[1] if hits else True

    def block_reason(self) -> str:
        """Why everything is closed, or ''."""
        return self.reason if self.disallow_all else ""

    def crawl_delay(self, token: str) -> float:
        g = self.group(token)
        return g.delay if g and g.delay is not None else 0.0


def parse_robots(text: str) -> Robots:
    out, group, closed = Robots(), None, False
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if group is None or closed:
                group, closed = Group(), False
                out.groups.append(group)
            group.agents.append(value.lower())
        elif name == "sitemap":
            if value:
                out.sitemaps.append(value)
        elif group is not None and name in ("allow", "disallow", "crawl-delay"):
            closed = True
            if name == "crawl-delay":
                try:
                    seconds = float(value)
                except ValueError:
                    continue
                if seconds >= 0:
                    group.delay = seconds
            elif value:
                group.rules.append((name == "allow", value))
    return out


def directives(value: str, token: str) -> tuple[bool, bool]:
    """noindex and nofollow of a robots directive list."""
    token, names = token.strip().lower(), set()
    for p in value.lower().split(","):
        agent, colon, rest = p.partition(":")
        if not colon:
            names.add(p.strip())
        elif agent.strip() == "*" or token in agent.strip():
            names.add(rest.strip())
    return bool(names & {"noindex", "none"}), bool(names & {"nofollow", "none"})


def allowed_by_rules(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the rules (allow, pattern) of one robots.txt allow a path: the longest pattern that matches decides, allow at a tie.

    The rules are one site's file and become one expression, so no row moves.
    """
    hits = [F.when(path.rlike(pattern_regex(p)), F.lit(2 * len(p.encode()) + allow)) for allow, p in rules]
    if not hits:
        return F.lit(True)
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return F.coalesce(best % 2 == 1, F.lit(True))


#: What ends a line of a file.
_LINES = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_SPECIAL = r"([\\^$.|?+()\[\]{}])"


def _from(entries: Column, at: Column) -> Column:
    """The entries from a place on, counted from 1; all of them gone where it is beyond the end."""
    return F.slice(entries, at, F.greatest(F.size(entries) - at + 1, F.lit(0)))


def entries(body: Column) -> Column:
    """The lines of a robots.txt that belong to groups, in order: name and value."""
    text = F.transform(F.split(F.coalesce(body, F.lit("")), _LINES, -1), lambda x: F.substring_index(x, "#", 1))
    with_colon = F.filter(text, lambda x: F.contains(x, F.lit(":")))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    pair = lambda x: F.struct(F.lower(bare(F.substring_index(x, ":", 1))).alias("name"), bare(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    return F.filter(F.transform(with_colon, pair), lambda e: e["name"].isin("user-agent", "allow", "disallow", "crawl-delay"))


def token_rules(files: DataFrame, body: str, token: str) -> DataFrame:
    """files with rules (allow, pattern, regex or null for a plain prefix, length) and delay of the group that holds for a token.

    The first group with an agent that contains the token, else the first for *. A file is a row and is read with
    array functions, so there may be as many files as there are hosts.
    """
    token = token.lower()
    agent = lambda e: e["name"] == "user-agent"
    first = lambda entries, test: F.array_position(F.transform(entries, test), F.lit(True))
    named = lambda e: agent(e) & (e["value"] != "*") & F.contains(F.lower(e["value"]), F.lit(token)) & F.lit(bool(token))
    out = files.withColumn("_entries", entries(F.col(body)))
    out = out.withColumn("_at", F.coalesce(F.nullif(first(F.col("_entries"), named), F.lit(0)), first(F.col("_entries"), lambda e: agent(e) & (e["value"] == "*"))).cast("int"))
    # what stands between the agents of the group and those of the next one
    out = out.withColumn("_rest", F.when(F.col("_at") > 0, _from(F.col("_entries"), F.col("_at") + 1)).otherwise(F.slice("_entries", 1, 0)))
    out = out.withColumn("_own", first(F.col("_rest"), lambda e: ~agent(e)).cast("int"))
    out = out.withColumn("_rest", F.when(F.col("_own") > 0, _from(F.col("_rest"), F.col("_own"))).otherwise(F.slice("_rest", 1, 0)))
    out = out.withColumn("_next", first(F.col("_rest"), agent).cast("int"))
    out = out.withColumn("_rest", F.when(F.col("_next") > 0, F.slice("_rest", 1, F.col("_next") - 1)).otherwise(F.col("_rest")))

    def rule(e):
        pattern = e["value"]
        end = F.endswith(pattern, F.lit("$"))
        open_ = F.when(end, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
        regex = F.concat(F.lit("^"), F.replace(F.regexp_replace(open_, _SPECIAL, r"\\$1"), F.lit("*"), F.lit(".*")), F.when(end, F.lit("$")).otherwise(F.lit("")))
        return F.struct((e["name"] == "allow").alias("allow"), pattern.alias("pattern"), F.when(end | F.contains(pattern, F.lit("*")), regex).alias("regex"), F.octet_length(pattern).alias("length"))

    rules = F.transform(F.filter("_rest", lambda e: (e["name"] != "crawl-delay") & (e["value"] != "")), rule)
    delays = F.filter(F.transform(F.filter("_rest", lambda e: e["name"] == "crawl-delay"), lambda e: e["value"].try_cast("double")), lambda x: x >= 0)
    return out.select(*files.columns, rules.alias("rules"), F.coalesce(F.try_element_at(delays, F.lit(-1)), F.lit(0.0)).alias("delay"))


def allowed_by_host(urls: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """urls (host, path, ...) with allowed and delay, by the files (host, body) of their hosts; a host without a file allows all.

    Files are parsed before they meet URLs, a row a host. The join by host is a broadcast only where Spark sees that the parsed
    files are small; a host of very many URLs is split by adaptive execution.
    """
    rules = token_rules(files, "body", token).select("host", "rules", "delay")
    path = F.col("path")
    hit = lambda r: F.when(r["regex"].isNull(), F.startswith(path, r["pattern"])).otherwise(F.regexp_like(path, r["regex"]))
    best = F.aggregate("rules", F.lit(-1), lambda a, r: F.greatest(a, F.when(hit(r), 2 * r["length"] + r["allow"].cast("int")).otherwise(-1)))
    best = F.coalesce(best, F.lit(-1))
    return urls.join(rules, "host", "left").select(*urls.columns, ((best < 0) | (best % 2 == 1)).alias("allowed"), F.coalesce("delay", F.lit(0.0)).alias("delay"))

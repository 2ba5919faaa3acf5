"""Small text sources: seed lists, sitemaps, robots rules, configuration and CV texts."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.urls import host, is_careers_page, normalize, scheme
from heronry.session import shipped


def parse_seeds(lists: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(urls, invalid) of seed lists: text after # is dropped, a bare host is https, others than http(s) and hosts without a dot are invalid.

    Line numbers come from the text itself, so they hold however the rows are split.
    """
    keep = [c for c in lists.columns if c != column]
    rows = lists.select(*keep, F.posexplode(F.split(column, r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.substring_index("raw", "#", 1))
    rows = rows.select(*keep, (F.col("pos") + 1).alias("line"), line.alias("text")).where("text <> ''")
    full = F.when(F.contains("text", F.lit("://")), F.col("text")).otherwise(F.concat(F.lit("https://"), "text"))
    rows = rows.withColumn("full", full)
    reason = F.when(host("full").isNull(), "no URL").when(~scheme("full").isin("http", "https"), "unsupported scheme").when(~F.contains(host("full"), F.lit(".")), "host must be a domain name")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(*keep, "line", normalize("full").alias("url")), rows.where("reason is not null").select(*keep, "line", "text", "reason")


def parse_sitemaps(maps: DataFrame, column: str = "xml") -> DataFrame:
    """(the row's other columns, is_index, loc): a text scan that copes with broken XML."""
    keep = [c for c in maps.columns if c != column]
    locs = F.regexp_extract_all(column, F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))
    clean = F.replace(F.trim(F.regexp_replace(F.trim(F.col("loc")), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit("&amp;"), F.lit("&"))
    return maps.select(*keep, F.contains(F.lower(column), F.lit("<sitemapindex")).alias("is_index"), F.explode(locs).alias("loc")).withColumn("loc", clean)


def child_order(loc: str = "loc"):
    """Sitemaps named like careers or jobs first, then pages, then others."""
    p = F.lower(F.regexp_extract(F.col(loc), r"^[a-z]+://[^/]*(.*)$", 1))
    return F.when(F.contains(p, F.lit("career")) | F.contains(p, F.lit("job")), 0).when(F.contains(p, F.lit("page")), 1).otherwise(2)


def careers_from_sitemap(locs: DataFrame, domain: str, most: int = 3) -> DataFrame:
    """(url): a domain's careers pages among sitemap entries, the shallowest and shortest."""
    from heronry.operators.topk import shallowest

    return shallowest(locs.select(normalize("loc").alias("url")).where(is_careers_page("url", F.lit(domain))), most)


def discover(maps: DataFrame, domain: str, roots: int = 2, children: int = 3) -> DataFrame:
    """(url): careers pages in a site's sitemaps (url, xml, root): the first roots, and of an index's children the most promising, one level deep."""
    first = maps.where("root").orderBy("url").limit(roots)
    locs = parse_sitemaps(first.select("url", "xml"))
    next_ = locs.where("is_index").withColumn("k", child_order()).orderBy("k", "loc").limit(children).select(F.col("loc").alias("url"))
    below = parse_sitemaps(maps.join(next_, "url", "left_semi").select("url", "xml")).where("not is_index")
    return careers_from_sitemap(locs.where("not is_index").select("loc").unionByName(below.select("loc")), domain)


def robots_filter(df: DataFrame, agent: str) -> DataFrame:
    """`df` (path, status, robots) with `allowed`, in Arrow batches."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", allowed boolean"

    def run(batches):
        for b in batches:
            b["allowed"] = [robots_decision(None if pd.isna(s) else int(s), r or "", agent, p or "/") for s, r, p in zip(b["status"], b["robots"], b["path"])]
            yield b

    return df.transform(shipped).mapInPandas(run, schema)


def robots_allowed(robots: str, agent: str, path: str) -> bool:
    """Whether robots.txt lets an agent fetch a path: its own group, else that of *; the longest rule counts, a tie allows."""
    import re

    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    fresh = False
    for raw in robots.splitlines():
        key, _, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not fresh:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            fresh = True
        elif key in ("allow", "disallow") and groups:
            fresh = False
            if value:
                groups[-1][1].append((key == "allow", value))
    name = agent.lower()
    mine = [r for names, rules in groups if any(n != "*" and n in name for n in names) for r in rules]
    if not any(any(n != "*" and n in name for n in names) for names, _ in groups):
        mine = [r for names, rules in groups if "*" in names for r in rules]
    best = (-1, True)
    for allow, rule in mine:
        pattern = re.escape(rule.rstrip("$")).replace(r"\*", ".*") + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allow))
    return best[1]


def robots_decision(status: int | None, robots: str, agent: str, path: str) -> bool:
    """A missing file allows, an unreachable one disallows, a present one is obeyed."""
    if status is None or status >= 500:
        return False
    return True if 400 <= status < 500 else robots_allowed(robots, agent, path)


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; unknown names are an error."""

    database: str = "data"
    max_depth: int = 5
    discovery_pages: int = 3
    harvest_pages: int = 30
    sample_ms: int = 2000
    max_bytes: int | None = None

    @classmethod
    def from_toml(cls, text: str) -> Config:
        import tomllib

        given = tomllib.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)


def cv_text(body: bytes, most: int = 5 * 1024 * 1024) -> str:
    """Plain text of an uploaded text or Markdown file; an error tells why it can't be one."""
    if len(body) > most:
        raise ValueError("the file is too large")
    if body[:5] == b"%PDF-" or body[:2] == b"PK":
        raise ValueError("only text files are read here")
    if b"\0" in body:
        raise ValueError("the file isn't text")
    try:
        text = body.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ValueError("the file isn't UTF-8") from e
    lines = [" ".join(x.split()) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    tidy = "\n".join(lines).strip()
    while "\n\n\n" in tidy:
        tidy = tidy.replace("\n\n\n", "\n\n")
    if sum(not c.isspace() for c in tidy) < 40:
        raise ValueError("there is too little text")
    return tidy

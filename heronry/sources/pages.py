"""Raw pages: bytes to text, HTML to a record with links, JSON-LD and visible text, and postings in JSON-LD."""

from __future__ import annotations

import gzip
import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.urls import TRACKING
from heronry.session import shipped

PAGE = """title string, canonical string, noindex boolean, nofollow boolean, links array<struct<url: string, text: string, nofollow: boolean>>, og_site_name string, json_ld array<string>, text string,
  footer_text string, embeds array<string>"""
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_TEXT, MOST_FOOTER, FOOTER_TAIL, MOST_ANCHOR = 100_000, 3_000, 1_500, 200


def decompress(encoding: str | None, wire: bytes, limit: int) -> bytes | None:
    """The decoded body; None where it's broken or larger than the limit. One byte over the limit is enough to know."""
    try:
        if encoding in (None, "", "identity"):
            out = wire[: limit + 1]
        elif encoding in ("gzip", "x-gzip"):
            out = zlib.decompressobj(31).decompress(wire, limit + 1)
        elif encoding == "deflate":
            try:
                out = zlib.decompressobj().decompress(wire, limit + 1)
            except zlib.error:
                out = zlib.decompressobj(-15).decompress(wire, limit + 1)
        else:
            return None
    except (zlib.error, gzip.BadGzipFile, EOFError):
        return None
    return None if len(out) > limit else out


def decode_html(body: bytes, content_type: str | None = None) -> str:
    """Text by byte order mark, else the header's charset, else that of a meta tag in the first 1,024 bytes, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def decode_bodies(df: DataFrame, limit: int = 5 * 1024 * 1024) -> DataFrame:
    """`df` (body, encoding, content_type) with `html`: null for bodies that are broken, of unknown encoding or larger than the limit once decoded."""
    keep = [f for f in df.schema.fields if f.name not in ("body", "encoding", "content_type")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "html string"])

    def one(body: bytes | None, encoding: str | None, kind: str | None) -> str | None:
        raw = None if body is None else decompress(encoding, bytes(body), limit)
        return None if raw is None else decode_html(raw, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[f.name for f in keep]].reset_index(drop=True)
            out["html"] = [one(*r) for r in zip(b["body"], b["encoding"], b["content_type"])]
            yield out

    return df.transform(shipped).mapInPandas(run, schema)


def normalize_url(url: str) -> str | None:
    """The same form as the column expression gives, for use inside the parser."""
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    default = {"http": 80, "https": 443}[u.scheme.lower()]
    path = re.sub(r"(?i);jsessionid=.*$", "", u.path) or "/"
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith("utm_"))
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    return f"{u.scheme.lower()}://{u.hostname}{f':{port}' if port and port != default else ''}{path}{'?' + query if query else ''}"


def resolve(base: str, href: str) -> str | None:
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        return normalize_url(urljoin(base, href))
    except ValueError:
        return None


def squeeze(s: str) -> str:
    return " ".join(s.split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title: list[str] | None = None
        self.base = self.canonical = self.site = None
        self.robots: list[str] = []
        self.anchors: list[tuple[dict, list[str]]] = []
        self.open: list[list[str]] = []
        self.ld: list[list[str]] = []
        self.embeds: list[str] = []
        self.body: list[str] = []
        self.size = 0
        self.footers: list[str] = []
        self.reading_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and self.base is None and "href" in a:
            self.base = a["href"]
        elif tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").lower().split():
            self.canonical = a.get("href")
        elif tag == "meta":
            if a.get("name", "").lower() == "robots":
                self.robots += [x.strip() for x in a.get("content", "").lower().split(",")]
            if a.get("property", "").lower() == "og:site_name" and self.site is None:
                self.site = a.get("content")
        elif tag == "title" and self.title is None and "svg" not in self.stack:
            self.title, self.reading_title = [], True
        elif tag == "a" and "href" in a:
            self.anchors.append((a, []))
            self.open.append(self.anchors[-1][1])
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld.append([])
        if tag in ("iframe", "embed", "script") and a.get("src"):
            self.embeds.append(a["src"])
        if tag not in _VOID:
            self.stack.append("ld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.reading_title = False
        if tag == "a" and self.open:
            self.open.pop()
        for name in (tag, "ld" if tag == "script" else tag):
            if name in self.stack:
                while self.stack and self.stack.pop() != name:
                    pass
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ""
        if top == "ld":
            self.ld[-1].append(data)
            return
        if self.reading_title and self.title is not None:
            self.title.append(data)
            return
        for t in self.open:
            t.append(data)
        if top in _HIDDEN or "head" in self.stack:
            return
        if self.size < MOST_TEXT:
            self.body.append(data)
            self.size += len(data.encode("utf-8", "replace")) + 1
        if "footer" in self.stack and sum(map(len, self.footers)) < MOST_FOOTER:
            self.footers.append(data)


def parse_html(url: str, text: str) -> dict:
    """One page as a record; broken markup is read as far as it goes."""
    p = _Page()
    p.feed(text)
    p.close()
    base = urljoin(url, p.base) if p.base else url
    links, seen = [], set()
    for a, parts in p.anchors:
        u = resolve(base, a["href"])
        if u is None or u in seen:
            continue
        seen.add(u)
        label = squeeze("".join(parts)) or squeeze(a.get("aria-label") or a.get("title") or "")
        links.append({"url": u, "text": label[:MOST_ANCHOR], "nofollow": "nofollow" in a.get("rel", "").lower().split()})
    ld = []
    for block in p.ld:
        try:
            ld.append(json.dumps(json.loads("".join(block).strip())))
        except ValueError:
            continue
    body = squeeze(" ".join(p.body))
    foot = squeeze(" ".join(p.footers)) or body[-FOOTER_TAIL:]
    none = "none" in p.robots
    return {
        "title": squeeze("".join(p.title)) or None if p.title is not None else None, "canonical": resolve(base, p.canonical) if p.canonical else None, "noindex": none or "noindex" in p.robots,
        "nofollow": none or "nofollow" in p.robots, "links": links, "og_site_name": squeeze(p.site) or None if p.site else None, "json_ld": ld, "text": body, "footer_text": foot,
        "embeds": [u for u in (resolve(base, e) for e in p.embeds) if u],
    }


def visible_text(text: str) -> str:
    """What a reader sees of an HTML fragment; once more where that is markup again, as of a fragment that came escaped."""
    for _ in range(2):
        p = _Page()
        p.feed(text)
        p.close()
        text = squeeze(" ".join(p.body))
        if not any(sign in text for sign in ("</", "<p", "<br")):
            break
    return text


def parse_pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The row's other columns, url and the record's fields; null HTML is an empty page. Arrow batches, no shuffle."""
    keep = [f for f in df.schema.fields if f.name not in (url, html)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "url string", PAGE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_html(u or "", h or "") for u, h in zip(b[url], b[html])]
            out = b[[f.name for f in keep]].reset_index(drop=True)
            out["url"] = b[url].to_numpy()
            got = pd.DataFrame(rows, columns=[c.split()[0] for c in ("title s", "canonical s", "noindex b", "nofollow b", "links a", "og_site_name s", "json_ld a", "text s", "footer_text s", "embeds a")])
            yield pd.concat([out, got], axis=1)

    return df.transform(shipped).mapInPandas(run, schema)


def walk(value: object, wanted) -> list[dict]:
    """Nodes of JSON-LD whose type is wanted, in order; what lies in one isn't looked at."""
    if isinstance(value, list):
        return [n for v in value for n in walk(v, wanted)]
    if isinstance(value, dict):
        if _is(value.get("@type"), wanted):
            return [value]
        return [n for v in value.values() for n in walk(v, wanted)]
    return []


def _is(t: object, wanted) -> bool:
    return any(_is(x, wanted) for x in t) if isinstance(t, list) else isinstance(t, str) and wanted(t.rsplit("/", 1)[-1])


def is_organization(name: str) -> bool:
    return name.endswith("Organization") or name in ("Corporation", "LocalBusiness", "OnlineBusiness", "OnlineStore", "NGO")


def _text(v: object) -> str | None:
    if isinstance(v, str):
        return v.strip() or None
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, dict):
        return _text(v.get("name", v.get("@value")))
    return next((t for t in map(_text, v) if t), None) if isinstance(v, list) else None


def _number(v: object) -> float | None:
    try:
        return None if isinstance(v, bool) or v is None or isinstance(v, (dict, list)) else float(str(v).replace(",", "").strip())
    except ValueError:
        return None


def _list(v: object) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _place(p: object) -> str | None:
    a = p.get("address", p) if isinstance(p, dict) else p
    if isinstance(a, str):
        return a.strip() or None
    got = [t for t in (_text(a.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")) if t] if isinstance(a, dict) else []
    return ", ".join(got) or None


def postings(page_url: str, blocks: list[str] | None) -> list[dict]:
    """JobPosting records of a page's JSON-LD. One without an address has the page's if it's the only one there."""
    nodes = []
    for b in blocks or []:
        try:
            nodes += walk(json.loads(b), lambda n: n == "JobPosting")
        except ValueError:
            continue
    out = []
    for n in nodes:
        own = _text(n.get("url"))
        url = resolve(page_url, own) if own else page_url if len(nodes) == 1 else None
        title = _text(n.get("title")) or _text(n.get("name"))
        if not url or not title:
            continue
        places, pay = _list(n.get("jobLocation")), n.get("baseSalary")
        pay = pay if isinstance(pay, dict) else {}
        amount = pay.get("value")
        if isinstance(amount, dict):
            one = _number(amount.get("value"))
            lo, hi = _number(amount.get("minValue")), _number(amount.get("maxValue"))
            lo, hi = (one if lo is None else lo), (one if hi is None else hi)
            unit = _text(amount.get("unitText"))
        else:
            lo = hi = _number(amount)
            unit = None
        ident = n.get("identifier")
        lands = [_text(p["address"].get("addressCountry")) for p in places if isinstance(p, dict) and isinstance(p.get("address"), dict)]
        out.append({
            "posting_url": url, "external_id": _text(ident.get("value", ident) if isinstance(ident, dict) else ident), "title": title, "company": _text(n.get("hiringOrganization")), "location": "; ".join(filter(None, map(_place, places))) or None,
            "country": next((c for c in lands if c), None), "remote": next((t for t in map(_text, _list(n.get("jobLocationType"))) if t), None), "employment": next((t for t in map(_text, _list(n.get("employmentType"))) if t), None),
            "salary_min": lo, "salary_max": hi, "salary_currency": _text(pay.get("currency")), "period": unit, "posted": _text(n.get("datePosted")), "description": _text(n.get("description")),
        })
    return out


def organizations(pages: DataFrame) -> DataFrame:
    """(url, name, org_url) of every organisation in the JSON-LD of pages (url, json_ld), nested ones too."""

    def nested(v: object) -> list[dict]:
        if isinstance(v, list):
            return [n for x in v for n in nested(x)]
        if not isinstance(v, dict):
            return []
        own = [v] if _is(v.get("@type"), is_organization) else []
        return own + [n for x in v.values() for n in nested(x)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, blocks in zip(b["url"], b["json_ld"]):
                for t in blocks if blocks is not None else []:
                    try:
                        out += [(u, _text(n.get("name")) if isinstance(n.get("name"), str) else None, _text(n.get("url")) if isinstance(n.get("url"), str) else None) for n in nested(json.loads(t))]
                    except ValueError:
                        continue
            yield pd.DataFrame(out, columns=["url", "name", "org_url"])

    return pages.select("url", "json_ld").transform(shipped).mapInPandas(run, "url string, name string, org_url string")


_POSTING = "posting_url string, external_id string, title string, company string, location string, country string, remote string, employment string, salary_min double, salary_max double, salary_currency string, period string, posted string, description string"


def job_postings(pages: DataFrame) -> DataFrame:
    """Postings in the JSON-LD of pages (url, json_ld), one row each, with the fields brought to the model's forms in the JVM."""
    from heronry.functions.measures import datetime_ms
    from heronry.functions.text import employment_type, remote_mode, salary_period
    from heronry.sources.boards import country, plain_html

    names = [c.split()[0] for c in _POSTING.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"url": u, **p} for u, blocks in zip(b["url"], b["json_ld"]) for p in postings(u, list(blocks) if blocks is not None else [])]
            yield pd.DataFrame(rows, columns=["url", *names])

    raw = pages.select("url", "json_ld").transform(shipped).mapInPandas(run, f"url string, {_POSTING}")
    return raw.select(
        "url", "posting_url", "external_id", "title", "company", "location", country(F.col("country")).alias("country_code"), remote_mode("remote").alias("remote_mode"), employment_type("employment").alias("employment_type"),
        "salary_min", "salary_max", "salary_currency", salary_period("period").alias("salary_period"), datetime_ms("posted").alias("posted_at"), F.nullif(plain_html(F.col("description")), F.lit("")).alias("description"), F.lit("jsonld").alias("source"),
    )

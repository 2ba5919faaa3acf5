"""URLs as Column expressions: taken apart by one regular expression, put together again by concatenation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import col, simplify

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that only track, besides utm_*.
TRACKING = ("gclid", "fbclid", "msclkid", "dclid", "yclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "jsessionid", "phpsessid", "sessionid")
#: Labels that are registries of their own under a country's code, with the countries that have no such registries, those where every second label is one, and further ones by country.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "mil", "ne", "net", "nom", "or", "org")
NO_REGISTRIES = ("ch", "cz", "de", "dk", "eu", "fi", "is", "li", "lu", "nl", "no", "su")
ALL_REGISTRIES = ("bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg")
MORE_REGISTRIES = {
    "au": ("asn", "id"), "br": ("adv", "art", "blog", "eco", "emp", "eng", "ind", "inf", "jus", "leg", "srv", "tur"), "il": ("k12", "muni"), "in": ("firm", "gen", "ind", "nic", "res"), "jp": ("ad", "ed", "gr", "lg"),
    "ke": ("info", "me", "mobi", "sc"), "kr": ("hs", "pe", "re"), "ng": ("mobi", "name", "sch"), "nz": ("cri", "geek", "gen", "govt", "iwi", "kiwi", "maori", "school"), "pl": ("biz", "info", "waw"), "th": ("in", "mi"),
    "tr": ("av", "bbs", "bel", "biz", "dr", "gen", "info", "k12", "kep", "name", "pol", "tel", "tv", "web"), "uk": ("ltd", "me", "nhs", "plc", "police", "sch"), "vn": ("biz", "health", "info", "name", "pro"), "za": ("law", "school", "web"),
}
#: Job-board hosts whose first path segment names the company, and suffixes whose subdomain does.
PATH_TENANTS = {
    "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "job-boards.eu.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.eu.lever.co": "lever",
    "jobs.ashbyhq.com": "ashby", "jobs.smartrecruiters.com": "smartrecruiters", "apply.workable.com": "workable", "jobs.jobvite.com": "jobvite", "ats.rippling.com": "rippling",
}
SUBDOMAIN_TENANTS = {
    "myworkdayjobs.com": "workday", "bamboohr.com": "bamboohr", "recruitee.com": "recruitee", "teamtailor.com": "teamtailor", "breezy.hr": "breezy", "icims.com": "icims",
    "jobs.personio.de": "personio", "jobs.personio.com": "personio", "applytojob.com": "jazzhr",
}
VENDOR_SUBDOMAINS = ("www", "app", "api", "help", "support", "status", "blog", "docs", "go")
NON_TENANT_SEGMENTS = ("embed", "api", "v1", "static", "assets")
#: Words of careers pages.
CAREERS_TOKENS = (
    "careers", "career", "jobs", "job", "joinus", "join-us", "work-with-us", "workwithus", "hiring", "we-are-hiring", "vacancies", "vacancy", "openings", "open-positions", "open-roles", "positions", "opportunities",
    "recruitment", "karriere", "emplois", "empleo", "vacatures", "stellenangebote", "lavora-con-noi", "trabalhe-conosco",
)
CAREERS_PARTS = ("careers", "career", "jobs", "hiring", "vacancies")
CAREERS_PHRASES = ("career", "jobs", "job openings", "join us", "join our team", "we're hiring", "we are hiring", "work with us", "open roles", "open positions", "vacancies", "karriere")
#: Sites never worth crawling.
BLOCKED_DOMAINS = (
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "t.co", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com", "snapchat.com", "whatsapp.com", "wa.me", "t.me",
    "telegram.me", "telegram.org", "discord.gg", "discord.com", "threads.net", "medium.com", "substack.com", "wikipedia.org", "wikimedia.org", "google.com", "goo.gl", "bit.ly", "github.com", "gitlab.com", "stackoverflow.com",
    "npmjs.com", "amazon.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "careerbuilder.com", "simplyhired.com", "wellfound.com", "angel.co", "jobberman.com", "calendly.com", "typeform.com", "zoom.us", "list-manage.com",
)
BLOCKED_BRANDS = (
    "facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok", "pinterest", "reddit", "wikipedia", "google", "amazon", "indeed", "glassdoor", "ziprecruiter", "monster", "careerbuilder", "simplyhired", "jobberman",
    "stepstone", "reed", "totaljobs", "naukri", "seek", "jobstreet",
)
BLOCKED_HOSTS = ("apps.apple.com", "itunes.apple.com", "play.google.com")


class Parsed:
    """A URL that is taken apart in a column of its own: what functions of URLs ask for are its fields, so that nothing is parsed twice."""

    def __init__(self, name: str):
        self.name = name
        self.done: set[str] = set()  # fields that there are besides the parts

    def __getitem__(self, field: str) -> Column:
        return F.col(f"{self.name}.{field}")


def staged(df: DataFrame, url: str, name: str = "__url") -> tuple[DataFrame, Parsed]:
    """`df` with a column `name`, and the URL that functions of this module take instead of the column `url`."""
    # one search for all parts: they stand in the result between signs that no URL has
    raw = F.split(F.when(F.col(url).rlike(_URL), F.regexp_replace(F.col(url), _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5")), "\u0001")
    bare = df.withColumn(name, raw)
    get = lambda k: F.coalesce(F.try_element_at(name, F.lit(k)), F.lit(""))
    parts = F.struct(F.col(url).alias("url"), *[get(k).alias(n) for k, n in enumerate(("scheme", "host", "port", "path", "query"), 1)])
    out, u = bare.withColumn(name, parts), Parsed(name)
    for fields in ({"segments": segments, "labels": labels, "params": param_names}, {"domain": registrable_domain, "board": board}, {"blocked": is_blocked}):
        out = out.withColumn(name, F.struct(f"{name}.*", *[f(u).alias(n) for n, f in fields.items()]))
        u.done |= set(fields)
    return out, u


_FIELDS = {1: "scheme", 2: "host", 3: "port", 4: "path", 5: "query"}


def part(url: Column | str | Parsed, group: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query, as they stand; empty where missing or no URL."""
    return url[_FIELDS[group]] if isinstance(url, Parsed) else F.regexp_extract(col(url), _URL, group)


def text_of(url: Column | str | Parsed) -> Column:
    return url["url"] if isinstance(url, Parsed) else col(url)


def known(url: Column | str | Parsed, field: str, made: Callable[[], Column]) -> Column:
    """A field of a URL that was taken apart, once all of them are there; else what makes it."""
    return url[field] if isinstance(url, Parsed) and field in url.done else made()


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def host(url: Column | str) -> Column:
    """Host in lower case; null for what is no URL."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def _port(url: Column | str) -> Column:
    p, s = part(url, 3), scheme(url)
    default = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))
    return F.when((p == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), p))


def host_key(url: Column | str) -> Column:
    """Host, and the port where it isn't the scheme's."""
    return F.concat(host(url), _port(url))


def path(url: Column | str) -> Column:
    p = part(url, 4)
    return F.when(host(url).isNull(), F.lit(None)).when(p == "", F.lit("/")).otherwise(p)


def segments(url: Column | str) -> Column:
    """Non-empty path segments in lower case."""
    return known(url, "segments", lambda: F.filter(F.split(F.lower(F.coalesce(part(url, 4), F.lit(""))), "/"), lambda s: s != ""))


def param_names(url: Column | str) -> Column:
    return known(url, "params", lambda: F.transform(F.filter(F.split(F.coalesce(part(url, 5), F.lit("")), "&"), lambda p: p != ""), lambda p: F.lower(F.substring_index(p, "=", 1))))


def normalize(url: Column | str) -> Column:
    """The form pages are told apart by: no fragment, credentials, session ids, tracking parameters or default port; other parameters sorted, each with its "=".

    Scheme and host in lower case, an empty path is "/", a trailing slash stays. Null for what is no URL.
    """
    bare = F.regexp_replace(path(url), r"(?i);jsessionid=.*$", "")
    pairs = F.filter(F.split(part(url, 5), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.startswith(F.lower(p), F.lit("utm_")))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    return F.concat(scheme(url), F.lit("://"), host(url), _port(url), F.when(bare == "", F.lit("/")).otherwise(bare), query)


def without_dots(url: Column) -> Column:
    """A URL whose path has no segments . and .. any more, however many it had: each .. takes away the segment before it, and nothing at the root."""
    dots = lambda x: F.regexp_replace(x, "(?i)%2e", ".")

    def step(kept: Column, s: Column) -> Column:
        return F.when(dots(s) == ".", kept).when(dots(s) == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))

    segs = F.split(F.regexp_replace(part(url, 4), "^/", ""), "/")
    kept = F.array_join(F.aggregate(segs, F.array().cast("array<string>"), step), "/")
    folder = dots(F.element_at(segs, -1)).isin(".", "..") & (kept != "")
    rest = F.regexp_extract(url, r"[?#].*$", 0)
    return F.concat(F.regexp_extract(url, r"^[^:]+://[^/?#]*", 0), F.lit("/"), kept, F.when(folder, F.lit("/")).otherwise(F.lit("")), rest)


def resolve(base: Column | str, href: Column | str) -> Column:
    """An href against its page, normalised; null for fragments, other schemes and nothing. Dot segments are taken out."""
    h = F.trim(col(href))
    root = F.concat(scheme(base), F.lit("://"), host(base), _port(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
    joined = joined.when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("?")), F.concat(root, path(base), h)).otherwise(F.concat(root, folder, h))
    joined = F.when(joined.rlike(r"^[^?#]*/(?:\.|%2[eE])"), without_dots(joined)).otherwise(joined)
    ok = (h != "") & ~F.startswith(h, F.lit("#")) & joined.rlike(r"^(?i)https?://[^/]")
    return F.when(ok, normalize(joined))


def labels(url: Column | str | Parsed) -> Column:
    """The labels of the host, without a dot at its end; null for what is no URL."""
    return known(url, "labels", lambda: F.split(F.regexp_replace(host(url), r"\.$", ""), r"\."))


def registrable_domain(url: Column | str) -> Column:
    """The host's public suffix and one label before it; addresses as they are; null for a bare suffix.

    Suffixes have one label, or two where a country has registries of its own, by rule and fixed values; private suffixes count as names.
    """
    if isinstance(url, Parsed) and "domain" in url.done:
        return url["domain"]
    h, n = F.regexp_replace(host(url), r"\.$", ""), labels(url)
    two = F.array_join(F.slice(n, F.greatest(F.size(n) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(n, F.greatest(F.size(n) - 2, F.lit(1)), 3), ".")
    last, own = F.try_element_at(n, F.lit(-1)), F.try_element_at(n, F.lit(-2))
    more = [f"{r}.{c}" for c, rs in MORE_REGISTRIES.items() for r in rs]
    country = (F.length(last) == 2) & ~last.isin(*NO_REGISTRIES)
    # a country whose code is a registry's name too (org.co, co.cm) has its registries as others have
    listed = F.coalesce(country & (own.isin(*REGISTRIES) | last.isin(*ALL_REGISTRIES) | two.isin(*more)), F.lit(False))
    return F.when(h.rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^\["), h).when(listed & (F.size(n) > 2), three).when(~listed & (F.size(n) > 1), two)


def board(url: Column | str) -> Column:
    """Struct of vendor, token and host of the job board a URL belongs to; null where it belongs to none."""
    if isinstance(url, Parsed) and "board" in url.done:
        return url["board"]
    h, segs = host(url), segments(url)
    first = F.try_element_at(segs, F.lit(1))
    asked = F.nullif(F.lower(F.regexp_extract(part(url, 5), r"(?:^|&)for=([^&]*)", 1)), F.lit(""))
    token = F.when(first.isin(*NON_TENANT_SEGMENTS), asked).otherwise(first)
    vendor = F.try_element_at(F.create_map(*[F.lit(x) for kv in PATH_TENANTS.items() for x in kv]), F.coalesce(h, F.lit("")))
    sub_vendor, sub = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, v in SUBDOMAIN_TENANTS.items():
        mine = F.endswith(h, F.lit("." + suffix))
        sub_vendor = F.when(mine, v).otherwise(sub_vendor)
        sub = F.when(mine, F.substring_index(h, ".", 1)).otherwise(sub)
    ok_sub = sub.isNotNull() & ~sub.isin(*VENDOR_SUBDOMAINS)
    whole = lambda v, t: F.struct(v.alias("vendor"), t.alias("token"), h.alias("host"))
    return F.when(vendor.isNotNull() & token.isNotNull(), whole(vendor, token)).when(vendor.isNull() & ok_sub, whole(sub_vendor, sub))


def board_key(url: Column | str) -> Column:
    b = board(url)
    return F.when(b.isNotNull(), F.concat(b["vendor"], F.lit("/"), b["token"]))


def board_url(b: Column) -> Column:
    """A board's public page."""
    known = {"greenhouse": "https://job-boards.greenhouse.io/", "lever": "https://jobs.lever.co/", "ashby": "https://jobs.ashbyhq.com/"}
    out = None
    for v, root in known.items():
        c = F.concat(F.lit(root), b["token"])
        out = F.when(b["vendor"] == v, c) if out is None else out.when(b["vendor"] == v, c)
    own = F.startswith(b["host"], F.concat(b["token"], F.lit(".")))
    return out.when(own, F.concat(F.lit("https://"), b["host"], F.lit("/"))).otherwise(F.concat(F.lit("https://"), b["host"], F.lit("/"), b["token"]))


def matches_domain(token: Column | str, domain: Column | str) -> Column:
    """Whether a board's token can name the company of a domain: one holds the other; under three letters they are equal."""
    label, t = simplify(F.substring_index(col(domain), ".", 1)), simplify(token)
    return F.when((F.length(label) < 3) | (F.length(t) < 3), label == t).otherwise(F.contains(t, label) | F.contains(label, t))


def budget_key(url: Column | str) -> Column:
    """What a page's fetch counts against: its board, else its registrable domain, else its host."""
    return F.coalesce(board_key(url), registrable_domain(url), host(url))


def is_careers_segment(s: Column) -> Column:
    return s.isin(*CAREERS_TOKENS) | F.exists(F.split(s, "[-_.]"), lambda p: p.isin(*CAREERS_PARTS))


def careers_match(url: Column | str, anchor: Column | str) -> Column:
    """Struct in_url (path segment, or careers./jobs. subdomain) and in_anchor (phrase in the text)."""
    in_url = F.exists(segments(url), is_careers_segment) | F.coalesce(F.substring_index(host(url), ".", 1).isin("careers", "jobs"), F.lit(False))
    a = F.lower(F.coalesce(col(anchor), F.lit("")))
    in_anchor = F.lit(False)
    for p in CAREERS_PHRASES:
        in_anchor = in_anchor | F.contains(a, F.lit(p))
    return F.struct(in_url.alias("in_url"), in_anchor.alias("in_anchor"))


def looks_like_id(s: Column) -> Column:
    """Five digits in a row, or the shape of a UUID."""
    return s.rlike(r"\d{5}") | s.rlike(r"^[0-9a-fA-F]+(-[0-9a-fA-F]+){4}$")


def is_careers_page(url: Column | str, domain: Column | str) -> Column:
    """A landing page of a domain's careers: on the domain, no board, at most three segments, no posting's id."""
    segs = segments(url)
    return (registrable_domain(url) == col(domain)) & board(url).isNull() & (F.size(segs) <= 3) & ~F.exists(segs, looks_like_id) & careers_match(url, F.lit(""))["in_url"]


def is_main_home(url: Column | str, domain: Column | str) -> Column:
    return (path(url) == "/") & F.regexp_replace(host(url), r"^www\.", "").eqNullSafe(col(domain))


def depth(url: Column | str) -> Column:
    return F.size(segments(url))


def is_better_careers_url(existing: Column | str, candidate: Column | str) -> Column:
    """The shallower of two careers pages is better; any is better than none."""
    return host(existing).isNull() | (depth(candidate) < depth(existing))


def main_home_url(url: Column | str, domain: Column | str) -> Column:
    """A domain's root page; www. and the port stay if the page is on that host."""
    on = F.regexp_replace(host(url), r"^www\.", "").eqNullSafe(col(domain))
    return F.concat(scheme(url), F.lit("://"), F.when(on, host_key(url)).otherwise(col(domain)), F.lit("/"))


def probe_urls(url: Column | str, domain: Column | str) -> Column:
    """Where a company's careers page may be: /careers, /jobs, and the careers. subdomain of a name."""
    home, d = main_home_url(url, domain), col(domain)
    named = ~d.rlike(r"^[\d.]+$|^\[")
    return F.concat(F.array(F.concat(home, F.lit("careers")), F.concat(home, F.lit("jobs"))), F.when(named, F.array(F.concat(F.lit("https://careers."), d, F.lit("/")))).otherwise(F.array().cast("array<string>")))


def is_blocked(url: Column | str, domain: Column | str | None = None) -> Column:
    if isinstance(url, Parsed) and "blocked" in url.done and domain is None:
        return url["blocked"]
    d = registrable_domain(url) if domain is None else col(domain)
    return F.coalesce(host(url).isin(*BLOCKED_HOSTS), F.lit(False)) | F.coalesce(d.isin(*BLOCKED_DOMAINS) | F.substring_index(d, ".", 1).isin(*BLOCKED_BRANDS), F.lit(False))


def page_label(url: Column | str) -> Column:
    """What a page is called in a graph: path and query, or the host for a root page."""
    q = part(url, 5)
    return F.when((path(url) == "/") & (q == ""), host(url)).when(q == "", path(url)).otherwise(F.concat(path(url), F.lit("?"), q))

"""Link scores, crawl steering and company classification as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import urls as U
from heronry.functions.text import col, words

#: Weights of a link's signals.
BASE, ATS, CAREERS_PATH, CAREERS_ANCHOR, CAREERS_BOTH, EXTERNAL, COMPANY_PAGE = 10.0, 80.0, 50.0, 40.0, 60.0, 8.0, 4.0
DEPTH, SATURATION, MOST_SATURATION, NOFOLLOW, QUERY, ARCHIVE, CONTENT, COMPANY_DOMAIN, NOT_COMPANY = 2.0, 0.5, 10.0, 5.0, 2.0, 8.0, 4.0, 10.0, 15.0
#: File endings and path segments.
SKIPPED = (
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "avif", "ico", "bmp", "tif", "tiff", "mp4", "mov", "avi", "webm", "mp3", "wav", "ogg", "zip", "gz", "tar", "rar", "7z", "dmg", "exe", "msi", "apk", "css", "js", "json", "xml", "rss", "atom", "woff", "woff2", "ttf", "otf", "eot", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "txt", "ics",
)
DROPPED = (
    "login", "log-in", "signin", "sign-in", "signup", "sign-up", "register", "logout", "cart", "checkout", "basket", "account", "my-account", "wp-admin", "wp-login.php", "wp-json", "cdn-cgi", "xmlrpc.php", "feed", "share", "sharer", "print",
)
ARCHIVES = (
    "tag", "tags", "category", "categories", "author", "search", "page",
)
ARCHIVE_PARAMS = (
    "page", "p", "sort", "order", "filter", "replytocom", "s", "q",
)
SECTIONS = (
    "blog", "news", "press", "events", "articles", "resources", "podcast",
)
COMPANY_SEGMENTS = (
    "about", "about-us", "company", "team", "our-team", "our-story", "who-we-are", "contact", "contact-us",
)


def _any_in(segs: Column, listed: Sequence[str]) -> Column:
    return F.arrays_overlap(segs, F.array(*[F.lit(x) for x in listed])) & (F.size(segs) > 0)


def score_link(url: Column | str | U.Parsed, anchor: Column | str, nofollow: Column | str, source_domain: Column | str, depth: Column | str, pages: Column | str, status: Column | str) -> Column:
    """Struct of score and reasons of a discovered link; null for a link never to be followed."""
    segs, target = U.segments(url), U.registrable_domain(url)
    last = F.try_element_at(segs, F.lit(-1))
    ending = F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1))
    looped = F.exists(segs, lambda s: F.size(F.filter(segs, lambda o: o == s)) >= 3)
    never = (F.length(U.text_of(url)) > 2000) | U.is_blocked(url) | (F.size(segs) > 12) | looped | F.coalesce(ending.isin(*SKIPPED), F.lit(False)) | _any_in(segs, DROPPED)
    board = U.board(url).isNotNull()
    cm = U.careers_match(url, anchor)
    inside = target.eqNullSafe(col(source_domain)) & target.isNotNull()
    dated = F.coalesce(U.part(url, 4).rlike(r"/\d{4}/\d{1,2}(/|$)"), F.lit(False))
    archive = _any_in(segs, ARCHIVES) | dated | _any_in(U.param_names(url), ARCHIVE_PARAMS)
    d, n = F.coalesce(col(depth), F.lit(0)), F.coalesce(col(pages), F.lit(0))
    signals = [
        (board, F.lit(ATS), "ats"),
        (cm["in_url"] & cm["in_anchor"], F.lit(CAREERS_BOTH), "careers_path+anchor"),
        (cm["in_url"] & ~cm["in_anchor"], F.lit(CAREERS_PATH), "careers_path"),
        (~cm["in_url"] & cm["in_anchor"], F.lit(CAREERS_ANCHOR), "careers_anchor"),
        (~inside, F.lit(EXTERNAL), "external"),
        (inside & _any_in(segs, COMPANY_SEGMENTS), F.lit(COMPANY_PAGE), "company_page"),
        (archive, F.lit(-ARCHIVE), "archive"),
        (~archive & (U.part(url, 5) != ""), F.lit(-QUERY), "query"),
        (F.coalesce(F.try_element_at(segs, F.lit(1)).isin(*SECTIONS), F.lit(False)), F.lit(-CONTENT), "content_section"),
        (~board & F.coalesce(col(status) == "company", F.lit(False)), F.lit(COMPANY_DOMAIN), "company_domain"),
        (~board & F.coalesce(col(status) == "not_company", F.lit(False)), F.lit(-NOT_COMPANY), "not_company"),
        (F.coalesce(col(nofollow), F.lit(False)), F.lit(-NOFOLLOW), "nofollow"),
        (d > 0, d * -DEPTH, "depth"),
        (n > 0, -F.least(n * SATURATION, F.lit(MOST_SATURATION)), "saturation"),
    ]
    total, reasons = F.lit(BASE), []
    for on, points, name in signals:
        total = total + F.when(on, points).otherwise(0.0)
        reasons.append(F.when(on, F.lit(name)))
    return F.when(~never & U.host(url).isNotNull(), F.struct(total.alias("score"), F.array_compact(F.array(*reasons)).alias("reasons")))


#: departments' words in careers links, by category.
DEPARTMENTS = {
    "engineering": ("engineering", "engineers", "developers", "software", "technology", "tech"), "data": ("data", "analytics", "machine learning"), "product": ("product",), "design": ("design",), "sales": ("sales",),
    "marketing": ("marketing", "growth"), "customer_support": ("support", "customer success"), "operations": ("operations",), "finance": ("finance",), "hr": ("people", "recruiting", "talent"), "legal": ("legal",), "security": ("security",), "it": ("it",),
}
STEER_SEGMENTS = ("careers", "career", "jobs", "job", "positions", "openings", "vacancies", "join-us", "work-with-us", "opportunities")


def steering_boost(url: Column | str, anchor: Column | str, topics: Sequence[str], categories: Sequence[str]) -> Column:
    """Struct of points and reasons: 3 for each topic mentioned, 9 at most; 6 for a wanted department within a careers path."""
    text = F.concat(F.lit(" "), words(F.coalesce(col(anchor), F.lit(""))), F.lit(" "), words(U.path(url)), F.lit(" "))
    hits = F.lit(0)
    for t in dict.fromkeys(t for t in topics if len(t.encode()) >= 3):
        hits = hits + F.contains(text, F.lit(f" {t} ")).cast("int")
    dept = F.lit(False)
    for c in categories:
        for w in DEPARTMENTS.get(c, ()):
            dept = dept | F.contains(text, F.lit(f" {w} "))
    dept = dept & _any_in(U.segments(url), STEER_SEGMENTS)
    points = F.least(hits * 3.0, F.lit(9.0)) + F.when(dept, 6.0).otherwise(0.0)
    return F.struct(points.alias("points"), F.array_compact(F.array(F.when(hits > 0, "profile_topic"), F.when(dept, "profile_department"))).alias("reasons"))


#: Signs of a company's page and their weights; marks of parked domains.
LEGAL = (
    "inc", "incorporated", "ltd", "limited", "llc", "llp", "lp", "plc", "corp", "corporation", "gmbh", "ag", "bv", "nv", "pty", "sarl", "srl", "oy", "kk",
)
PARKED = ("domain is for sale", "domain may be for sale", "buy this domain", "this domain is parked", "domain parking", "parked free", "hugedomains.com", "sedo domain parking", "afternic", "dan.com")
ABOUT = (
    "about", "about-us", "company", "who-we-are", "our-story", "team", "our-team",
)
CONTACT = (
    "contact", "contact-us",
)
TERMS = (
    "terms", "tos", "terms-of-service", "terms-of-use", "terms-and-conditions", "legal", "imprint", "impressum",
)
WEIGHTS = {"org_json_ld": 0.25, "site_name": 0.05, "legal_suffix": 0.2, "copyright": 0.1, "careers_link": 0.2, "about_link": 0.1, "contact_link": 0.05, "privacy_link": 0.1, "terms_link": 0.05, "https": 0.05, "many_inbound": 0.1, "some_inbound": 0.05}


def link_signals(pages: DataFrame) -> DataFrame:
    """(id, found) of pages (id, domain, links: structs url, text): found tells whether a link leads to careers, about, contact, privacy and terms pages. Each link's url is taken apart once; flags are combined by page before the shuffle."""
    each = pages.select("id", "domain", F.explode("links").alias("l")).select("id", "domain", F.col("l.url").alias("url"), F.lower(F.coalesce("l.text", F.lit(""))).alias("t"))
    each, u = U.staged(each, "url")
    inside, has, m = U.registrable_domain(u).eqNullSafe(F.col("domain")), lambda w: F.contains("t", F.lit(w)), U.careers_match(u, "t")
    flags = {
        "careers": (m["in_url"] | m["in_anchor"]) & (inside | U.board(u).isNotNull()), "about": inside & (has("about") | _any_in(U.segments(u), ABOUT)), "contact": inside & (has("contact") | _any_in(U.segments(u), CONTACT)),
        "privacy": has("privacy") | F.exists(U.segments(u), lambda s: F.contains(s, F.lit("privacy"))), "terms": has("terms") | _any_in(U.segments(u), TERMS),
    }
    told = each.select("id", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    return told.groupBy("id").agg(*[F.max(k).alias(k) for k in flags]).select("id", F.struct(*flags).alias("found"))


def assess(url: Column | str | U.Parsed, title: Column, text: Column, footer: Column, found: Column, links: Column, has_org: Column, site_name: Column, inbound: Column) -> Column:
    """Struct of score in [0, 1], signals, parked and conclusive of one page. `found` is that of `link_signals`, null without any; `links` the number of its links."""
    empty = F.lit("")
    scan = F.lower(F.concat_ws(" ", F.substring(F.coalesce(text, empty), 1, 5000), F.coalesce(title, empty)))
    parked = F.lit(False)
    for p in PARKED:
        parked = parked | F.contains(scan, F.lit(p))
    foot = F.lower(F.coalesce(footer, empty))
    legal = _any_in(F.split(foot, r"[^\p{L}\p{N}]+"), LEGAL)
    rights = F.contains(foot, F.lit("©")) | F.contains(foot, F.lit("copyright")) | F.contains(foot, F.lit("(c) 20"))
    linked = lambda k: F.coalesce(found[k], F.lit(False))
    inb = F.coalesce(inbound, F.lit(0))
    on = {
        "org_json_ld": F.coalesce(has_org, F.lit(False)),
        "site_name": site_name.isNotNull(),
        "legal_suffix": legal,
        "copyright": rights,
        "careers_link": linked("careers"),
        "about_link": linked("about"),
        "contact_link": linked("contact"),
        "privacy_link": linked("privacy"),
        "terms_link": linked("terms"),
        "https": U.scheme(url) == "https",
        "many_inbound": inb >= 5,
        "some_inbound": (inb >= 2) & (inb < 5),
    }
    thin = (F.octet_length(F.coalesce(text, empty)) < 300) & (F.coalesce(links, F.lit(0)) < 5)
    score = F.lit(0.0)
    for k, c in on.items():
        score = score + F.when(c, F.lit(WEIGHTS[k])).otherwise(0.0)
    signals = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in on.items()], F.when(thin, F.lit("thin"))))
    return F.struct(
        F.when(parked, 0.0).otherwise(F.least(score, F.lit(1.0))).alias("score"), F.when(parked, F.array(F.lit("parked"))).otherwise(signals).alias("signals"), parked.alias("parked"), (parked | ~thin).alias("conclusive"),
    )

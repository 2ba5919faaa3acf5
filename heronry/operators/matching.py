"""How well postings fit a profile: one expression over the posting with the profile as literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.enrich import CATEGORIES
from heronry.functions.measures import LEVELS, distance_km, lookup
from heronry.functions.text import col, contains_any, simplify, word_array
from heronry.operators import filters as P
from heronry.operators.aggregates import facets as _facets

#: Weights of the parts and what unknowns count.
W_SKILLS, W_TITLE, W_SENIORITY, W_LOCATION, W_SALARY, NEUTRAL, CAP, HIT = 0.35, 0.25, 0.10, 0.20, 0.10, 0.5, 0.35, 0.7
#: Words of a title that tell only a level; neighbouring categories.
LEVEL_WORDS = ("senior", "sr", "junior", "jr", "lead", "staff", "principal", "head", "of", "the", "and", "intern")
NEIGHBOURS = (
    ("engineering", "data"), ("engineering", "security"), ("engineering", "it"), ("engineering", "product"), ("data", "product"), ("data", "finance"), ("product", "design"), ("sales", "marketing"), ("sales", "customer_support"),
    ("marketing", "design"), ("operations", "finance"), ("operations", "customer_support"), ("it", "security"),
)


@dataclass(frozen=True)
class Place:
    name: str
    country_code: str | None = None
    lat: float | None = None
    lon: float | None = None


@dataclass(frozen=True)
class Profile:
    titles: list[str] = field(default_factory=list)
    skills: dict[str, float] = field(default_factory=dict)
    seniority: str | None = None
    years: float | None = None
    locations: list[Place] = field(default_factory=list)
    remote: str | None = None
    relocate: bool = False
    salary_usd: float | None = None
    industries: list[str] = field(default_factory=list)
    must_have: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    excluded_companies: list[str] = field(default_factory=list)

    def level(self) -> str | None:
        """The stated level, else one from the years of experience."""
        if self.seniority or self.years is None:
            return self.seniority
        return next((n for y, n in ((2, "junior"), (5, "mid"), (9, "senior")) if self.years < y), "lead")


def merged(profile: Profile, overrides: dict) -> Profile:
    """A profile with the given fields replaced; null leaves a field, unknown names are an error."""
    from dataclasses import replace

    return replace(profile, **{k: v for k, v in overrides.items() if v is not None})


def _py_words(s: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in s.lower()).split()


def _py_category(title: str) -> str | None:
    text = " " + " ".join(_py_words(title)) + " "
    for name, keys in CATEGORIES:
        for k in keys:
            if f" {k}{' ' if ' ' in k or len(k.encode()) <= 3 else ''}" in text:
                return name
    return None


def title_overlap(title: Column | str, titles: Sequence[str]) -> Column:
    """The largest share of a wanted title's words that the posting's title has; level words don't count."""
    theirs = F.filter(word_array(title), lambda w: ~w.isin(*LEVEL_WORDS))
    shares = []
    for t in titles:
        own = [w for w in _py_words(t) if w not in LEVEL_WORDS]
        if own:
            shares.append(reduce(lambda a, w: a + F.array_contains(theirs, w).cast("int"), own, F.lit(0)) / F.lit(float(len(own))))
    return F.greatest(*shares, F.lit(0.0)) if shares else F.lit(0.0)


def _skills(p: Profile) -> Column:
    if not p.skills:
        return F.lit(NEUTRAL)
    worth = {k.lower(): min(1.0, 0.6 + 0.4 * min(max(v, 0.0), 1.0)) for k, v in p.skills.items()}
    s = F.col("skill_list")
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.coalesce(lookup(worth, F.lower(x)), F.lit(0.0)))
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, NEUTRAL).otherwise(total / F.size(s))


def _title(p: Profile) -> Column:
    if not p.titles:
        return F.lit(NEUTRAL)
    o = title_overlap("title", p.titles)
    cats = {c for c in map(_py_category, p.titles) if c}
    near = {b for a, b in NEIGHBOURS if a in cats} | {a for a, b in NEIGHBOURS if b in cats}
    c = F.col("category")
    return F.when(o >= 0.6, 1.0).when(o >= 0.34, 0.8).when(c.isNull(), NEUTRAL).when(c.isin(*cats) if cats else F.lit(False), 0.7).when(c.isin(*near) if near else F.lit(False), 0.4).otherwise(0.1)


def _seniority(p: Profile) -> Column:
    mine = LEVELS.get(p.level() or "")
    if mine is None:
        return F.lit(NEUTRAL)
    gap = F.abs(lookup(LEVELS, F.coalesce("seniority", F.lit(""))) - mine)
    return F.when(gap.isNull(), NEUTRAL).when(gap == 0, 1.0).when(gap == 1, 0.8).when(gap == 2, 0.35).otherwise(0.1)


def _location(p: Profile) -> Column:
    lands = [x.country_code for x in p.locations if x.country_code]
    home = F.col("country_code").isin(*lands) if lands else F.lit(False)
    regions = F.coalesce("remote_regions", F.array().cast("array<string>"))
    open_ = F.array_contains(regions, "global") | (F.arrays_overlap(regions, F.array(*map(F.lit, lands))) if lands else F.lit(False))
    remote = F.when(F.size(regions) == 0, 0.7).when(open_, 1.0).otherwise(0.3 if p.relocate else 0.15)
    if not p.locations:
        placed = F.lit(NEUTRAL)
    else:
        away = 0.3 if p.relocate else 0.05
        spots = [distance_km(F.col("lat"), F.col("lon"), F.lit(x.lat), F.lit(x.lon)) for x in p.locations if x.lat is not None and x.lon is not None]
        km = F.array_min(F.array(*spots)) if spots else F.lit(None).cast("double")
        near = F.when(km <= 50, 1.0).when(km <= 100, 0.8).when(km <= 250, 0.5).when(F.coalesce(home, F.lit(False)), 0.4).otherwise(away)
        by_land = F.when(F.coalesce(home, F.lit(False)), 0.5).otherwise(away)
        value = F.when(km.isNotNull(), near).when(F.col("country_code").isNotNull(), by_land)
        placed = F.coalesce(value * (0.5 if p.remote == "remote" else 1.0), F.lit(NEUTRAL))
    return F.when(F.col("remote_mode") == "remote", remote).otherwise(placed)


def _salary(p: Profile) -> Column:
    if p.salary_usd is None or p.salary_usd <= 0:
        return F.lit(NEUTRAL)
    r = F.col("salary_usd_annual") / p.salary_usd
    return F.when(r.isNull(), NEUTRAL).when(r >= 1, 1.0).when(r >= 0.8, 0.7).otherwise(0.2)


def _argmax(pairs: list[tuple[Column, str]]) -> Column:
    """The name of the first pair of the largest value above 0; null where none is."""
    best = F.greatest(*[v for v, _ in pairs], F.lit(0.0)) if pairs else F.lit(0.0)
    return F.coalesce(*[F.when((v == best) & (v > 0), F.lit(n)) for v, n in pairs], F.lit(None).cast("string"))


def _reasons(p: Profile) -> list[Column]:
    """What each part says of a posting, null where it's neutral, in the order of the parts."""
    text = F.concat
    n = F.coalesce(F.size("skill_list"), F.lit(0))
    mine = [k.lower() for k in p.skills]
    hit = F.filter("skill_list", lambda x: F.lower(x).isin(*mine))
    skills = F.when(n > 0, F.when(F.size(hit) == 0, text(F.lit("skills: none of "), n, F.lit(" match"))).otherwise(text(F.lit("skills: "), F.array_join(hit, ", "), F.lit(" ("), F.size(hit), F.lit("/"), n, F.lit(")")))) if p.skills else F.lit(None)
    like, o, c = _argmax([(title_overlap("title", [t]), t) for t in p.titles]), title_overlap("title", p.titles), F.col("category")
    value = _title(p)
    by_category = F.when(value == 0.7, text(F.lit("category: "), c)).when(value == 0.4, text(F.lit("category: near "), c)).otherwise(text(F.lit("category: "), c, F.lit(" is outside your titles")))
    title = F.when(o >= 0.6, text(F.lit("title: like "), like)).when(o >= 0.34, text(F.lit("title: close to "), like)).when(c.isNotNull(), by_category) if p.titles else F.lit(None)
    known = lookup(LEVELS, F.coalesce("seniority", F.lit(""))).isNotNull()
    level = F.when(known, text(F.lit("seniority: "), "seniority", F.lit(f" vs your {p.level()}"))) if LEVELS.get(p.level() or "") is not None else F.lit(None)
    lands = [x.country_code for x in p.locations if x.country_code]
    regions = F.coalesce("remote_regions", F.array().cast("array<string>"))
    open_ = F.array_contains(regions, "global") | (F.arrays_overlap(regions, F.array(*map(F.lit, lands))) if lands else F.lit(False))
    remote = F.when(F.size(regions) == 0, "remote").when(open_, "remote, open to you").otherwise("remote, but not open to your country")
    spots = [(distance_km(F.col("lat"), F.col("lon"), F.lit(x.lat), F.lit(x.lon)), x.name) for x in p.locations if x.lat is not None and x.lon is not None]
    place = F.lit(None).cast("string")
    if p.locations:
        home = F.coalesce(F.col("country_code").isin(*lands), F.lit(False)) if lands else F.lit(False)
        place = F.when(home, text(F.lit("location: in "), "country_code")).otherwise(text(F.lit("location: "), "country_code"))
        if spots:
            nearest = F.array_min(F.array(*[F.struct(km.alias("km"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (km, name) in enumerate(spots)]))
            known_km = F.col("lat").isNotNull() & F.col("lon").isNotNull()
            place = F.when(known_km, text(F.lit("location: "), F.bround(nearest["km"], 0).cast("bigint"), F.lit(" km from "), nearest["name"])).otherwise(place)
    location = F.when(F.col("remote_mode") == "remote", remote).otherwise(place)
    pay = F.when(F.col("salary_usd_annual").isNotNull(), F.when(_salary(p) == 1.0, "salary: at or above your expectation").when(_salary(p) == 0.7, "salary: a little under your expectation").otherwise("salary: well under your expectation")) if (p.salary_usd or 0) > 0 else F.lit(None)
    return [x.cast("string") for x in (skills, title, level, location, pay)]


def score(jobs: DataFrame, profile: Profile) -> DataFrame:
    """`jobs` with the five parts, `score` in [0, 1] and `reasons`: what excludes a posting, or what each part that isn't neutral says, then the terms that it must have and lacks.

    Needs title, company, host, description, category, seniority, skill_list, lat, lon, country_code, remote_mode, remote_regions,
    salary_usd_annual. All in the JVM, no shuffle; of descriptions only the first 3,000 characters are looked at for terms.
    """
    e, none = F.lit(""), F.lit(None).cast("string")
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", e), F.coalesce("company", e), F.substring(F.coalesce("description", e), 1, 3000)))
    out = jobs.withColumn("__hay", hay)
    company = none
    for c in reversed(profile.excluded_companies):
        k = "".join(ch for ch in c.lower() if ch.isalnum())
        if len(k.encode()) >= 3:
            named = F.coalesce(F.contains(simplify("company"), F.lit(k)), F.lit(False)) | F.coalesce(simplify(F.substring_index("host", ".", 1)) == k, F.lit(False))
            company = F.when(named, f"excluded company: {c}").otherwise(company)
    term = none
    for t in reversed([t for t in profile.exclude if t.strip()]):
        term = F.when(F.contains("__hay", F.lit(t.strip().lower())), f'excluded: mentions "{t}"').otherwise(term)
    missing = F.array_compact(F.array(*[F.when(~F.contains("__hay", F.lit(t.strip().lower())), F.lit(t)) for t in profile.must_have if t.strip()])).cast("array<string>")
    parts = {"p_skills": (W_SKILLS, _skills), "p_title": (W_TITLE, _title), "p_seniority": (W_SENIORITY, _seniority), "p_location": (W_LOCATION, _location), "p_salary": (W_SALARY, _salary)}
    out = out.withColumns({k: f(profile) for k, (_, f) in parts.items()} | {"__missing": missing, "__out": F.coalesce(company, term)})
    total = reduce(lambda a, kv: a + F.col(kv[0]) * kv[1][0], parts.items(), F.lit(0.0))
    lacks = F.size("__missing") > 0
    capped = F.when(lacks, F.least(total, F.lit(CAP))).otherwise(total)
    said = F.array_compact(F.array(*_reasons(profile), F.when(lacks, F.concat(F.lit("missing must-have: "), F.array_join("__missing", ", ")))))
    reasons = F.when(F.col("__out").isNotNull(), F.array("__out")).otherwise(said)
    return out.withColumn("score", F.when(F.col("__out").isNotNull(), 0.0).otherwise(F.least(F.greatest(capped, F.lit(0.0)), F.lit(1.0)))).withColumn("reasons", reasons).drop("__hay", "__missing", "__out")


def browse(matches: DataFrame, jobs: DataFrame, domains: DataFrame, profile_id: int, q: str = "", min_score: float = 0.0, days: int | None = None, now: int = 0, has_salary: bool = False, sort: str = "score", limit: int = 25, offset: int = 0, **equal: str | None) -> tuple[DataFrame, DataFrame]:
    """(total, page) of a profile's matches with open postings. Sorts: score, recent, salary."""
    from heronry.operators.topk import with_domain

    m = P.score_floor(matches.where(F.col("profile_id") == profile_id), min_score).select("job_id", "score", "reasons", "computed_at")
    j = P.equalities(P.open_jobs(jobs), **equal)
    if has_salary:
        j = j.where("salary_usd_annual is not null")
    if days:
        j = P.recent(j, now, days)
    both = with_domain(m.join(j, F.col("job_id") == F.col("id")), domains)
    if q.strip():
        both = both.where(contains_any(["title", "company", "host"], q.strip()))
    total = both.agg(F.count("*").alias("total"))
    s = F.desc_nulls_last("score")
    order = {"score": [s], "recent": [F.desc_nulls_last(F.coalesce("posted_at", "first_seen")), s], "salary": [F.desc_nulls_last("salary_usd_annual"), s]}[sort]
    page = both.orderBy(*order, "job_id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))
    return total, page.select("job_id", "score", "title", P.shown().alias("company"), "location", "salary_usd_annual")


def facets(matches: DataFrame, jobs: DataFrame, profile_id: int) -> tuple[DataFrame, DataFrame]:
    """(facet rows, totals) of a profile's matches with open postings."""
    both = matches.where(F.col("profile_id") == profile_id).join(P.open_jobs(jobs), F.col("job_id") == F.col("id"))
    totals = both.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= HIT).alias("strong"), F.count_if(F.col("score") >= 0.5).alias("good"))
    return _facets(both, ["category", "seniority", "country_code"]), totals


__all__ = ["Place", "Profile", "browse", "col", "facets", "merged", "score", "title_overlap"]

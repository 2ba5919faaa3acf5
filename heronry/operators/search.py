"""Job search: a query is cleaned on the driver, then becomes one plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.enrich import CATEGORIES
from heronry.functions.measures import bbox, distance_km
from heronry.operators import filters as P
from heronry.operators.aggregates import percentile_threshold
from heronry.operators.fulltext import bm25, hits
from heronry.operators.topk import ordered, with_domain
from heronry.sources.gazetteer import find_place

#: Limits of a query.
MOST_KEYWORDS, KEYWORD_CHARS, MOST_CATEGORIES, MOST_INDUSTRIES, RADIUS, PERCENTILE, MOST_SALARY, MOST_DAYS, LIMIT = 8, 40, 5, 3, (1.0, 500.0, 50.0), (0.01, 0.9), 1e7, 3650, (1, 200, 50)
SORTS = ("match", "relevance", "recent", "salary_desc")
REMOTE = ("remote", "hybrid", "onsite", "any")
KNOWN = tuple(c for c, _ in CATEGORIES) + ("other",)


@dataclass(frozen=True)
class JobQuery:
    keywords: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    near: str | None = None
    radius_km: float | None = None
    remote: str | None = None
    salary_mode: str | None = None  # top_percentile or min_usd
    salary_value: float = 0.0
    posted_within_days: int | None = None
    sort: str | None = None
    limit: int | None = None


def _one_of(value: str, allowed: tuple[str, ...]) -> str | None:
    v = value.strip().lower().replace(" ", "_").replace("-", "_")
    return v if v in allowed else None


def sanitized(q: JobQuery) -> tuple[JobQuery, list[str]]:
    """The query within its limits, and notes on what was ignored."""
    notes: list[str] = []
    words: list[str] = []
    for k in (k.strip()[:KEYWORD_CHARS] for k in q.keywords):
        if k and len(words) < MOST_KEYWORDS and k.lower() not in map(str.lower, words):
            words.append(k)
    if len(words) < len(q.keywords):
        notes.append(f"{len(q.keywords) - len(words)} keyword(s) ignored: at most {MOST_KEYWORDS} are used")
    cats: list[str] = []
    for c in q.categories:
        k = _one_of(c, KNOWN)
        if k is None:
            notes.append(f'unknown category "{c.strip()}" ignored')
        elif k not in cats:
            cats.append(k)
    inds = list(dict.fromkeys(i.strip().lower() for i in q.industries if i.strip()))[:MOST_INDUSTRIES]
    near = (q.near or "").strip()[:80] or None
    if q.near is not None and near is None:
        notes.append('"near" named no place: ignored')
    remote = None
    if q.remote is not None:
        remote = _one_of(q.remote, REMOTE)
        if remote is None:
            notes.append(f'unknown work style "{q.remote.strip()}" ignored')
        remote = None if remote == "any" else remote
    mode, value = None, 0.0
    if q.salary_mode is not None:
        m = _one_of(q.salary_mode, ("top_percentile", "min_usd"))
        finite = q.salary_value == q.salary_value and abs(q.salary_value) != float("inf")
        if m == "top_percentile" and finite and q.salary_value > 0:
            mode, value = m, min(max(q.salary_value, PERCENTILE[0]), PERCENTILE[1])
        elif m == "min_usd" and finite and q.salary_value >= 1:
            mode, value = m, min(q.salary_value, MOST_SALARY)
        else:
            notes.append(f'salary filter "{q.salary_mode.strip()} {q.salary_value}" ignored')
    sort = None
    if q.sort is not None:
        sort = _one_of(q.sort, SORTS)
        if sort is None:
            notes.append(f'unknown sort "{q.sort.strip()}" ignored')
    radius = min(max(q.radius_km if q.radius_km is not None else RADIUS[2], RADIUS[0]), RADIUS[1]) if near else None
    days = None if q.posted_within_days is None else min(max(q.posted_within_days, 1), MOST_DAYS)
    limit = min(max(q.limit if q.limit is not None else LIMIT[2], LIMIT[0]), LIMIT[1])
    return replace(q, keywords=words, categories=cats[:MOST_CATEGORIES], industries=inds, near=near, radius_km=radius, remote=remote, salary_mode=mode, salary_value=value, posted_within_days=days, sort=sort, limit=limit), notes


def resolve_sort(q: JobQuery, has_profile: bool) -> tuple[str, list[str]]:
    """The order asked for where it can apply, else the newest first, with a note."""
    wanted = q.sort or ("match" if has_profile else "relevance" if q.keywords else "recent")
    if wanted == "match" and not has_profile:
        return "recent", ["no CV profile to rank by: newest first"]
    if wanted == "relevance" and not q.keywords:
        return "recent", ["no keywords to rank by: newest first"]
    return wanted, []


def run(jobs: DataFrame, domains: DataFrame, query: JobQuery, now: int, places: DataFrame | None = None, matches: DataFrame | None = None, profile_id: int | None = None, relevance_compat: bool = False, placed_only: bool = False) -> tuple[DataFrame, list[str], str]:
    """(hits, notes, sort). Nothing runs but the lookup of the place; a salary percentile stays a join with one row.

    The percentile is of the postings that fit all other filters, before the exact circle is cut. `relevance_compat` orders relevance by
    id alone, as an engine does whose rank function sees no match. Hits always have `distance_km`, null without coordinates on either side.
    `placed_only` finds nothing around a place that has none, instead of searching its country or everywhere.
    """
    q, notes = sanitized(query)
    spot = find_place(places, q.near) if q.near and places is not None else None
    if q.near and spot is None:
        notes.append(f'couldn\'t place "{q.near}": searching everywhere')
    sort, more = resolve_sort(q, profile_id is not None)
    notes += more
    text = {"title": F.col("title"), "description": F.col("description"), "skills": F.col("skills")}
    j = P.open_jobs(jobs)
    if q.keywords:
        j = bm25(j, text, q.keywords) if sort == "relevance" and not relevance_compat else hits(j, text, q.keywords)
    if q.categories:
        j = j.where(F.col("category").isin(*q.categories))
    j = with_domain(j, domains)
    if q.industries:
        j = j.where(P.loose_contains("industry", q.industries))
    if q.remote:
        j = j.where(F.col("remote_mode") == q.remote)
    if q.posted_within_days:
        j = P.recent(j, now, q.posted_within_days)
    centre = spot if spot and spot.get("lat") is not None else None
    if centre:
        j = j.where(P.place(bbox(centre["lat"], centre["lon"], q.radius_km), centre["country_code"]))
    elif spot:
        j = j.where((F.col("country_code") == spot["country_code"]) | P.remote_open(spot["country_code"]))
    if q.near and placed_only and not centre:
        j = j.where(F.lit(False))
    if profile_id is not None and matches is not None:
        mine = matches.where(F.col("profile_id") == profile_id).select(F.col("job_id").alias("id"), F.col("score").alias("match_score"))
        j = j.join(mine, "id", "left")
    if q.salary_mode == "min_usd":
        notes.append(f"paying at least ${q.salary_value:.0f}/yr; jobs that posted none can't match")
        j = j.where(F.col("salary_usd_annual") >= q.salary_value)
    elif q.salary_mode == "top_percentile":
        notes.append(f"the top {round(q.salary_value * 100)}% of the matching jobs that posted a salary")
        j = j.crossJoin(F.broadcast(percentile_threshold(j, "salary_usd_annual", q.salary_value))).where("salary_usd_annual >= threshold").drop("threshold")
    by = "recent" if sort == "relevance" and "relevance" not in j.columns else sort
    if centre:
        km = distance_km(F.lit(centre["lat"]), F.lit(centre["lon"]), F.col("lat"), F.col("lon"))
        j = j.withColumn("km", km).where(F.col("km").isNull() | (F.col("km") <= q.radius_km)).withColumn("distance_km", F.round("km", 1)).drop("km")
    else:
        j = j.withColumn("distance_km", F.lit(None).cast("double"))
    if sort == "relevance" and relevance_compat:
        return j.orderBy(F.desc("id")).limit(q.limit), notes, sort
    return ordered(j, by, q.limit), notes, sort

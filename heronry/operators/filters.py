"""Predicates on postings, domains and pages. All are Columns that Catalyst can push to the scan where they are simple."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.measures import DAY_MS, distance_km


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("closed_at is null")


def unchanged(a: str, b: str, fields: Sequence[str]) -> Column:
    """Whether two aliased rows agree in all fields, nulls being equal."""
    return reduce(lambda x, f: x & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), fields, F.lit(True))


def loose_contains(column: str, needles: Sequence[str]) -> Column:
    hay = F.lower(F.coalesce(F.col(column), F.lit("")))
    return reduce(lambda x, n: x | (F.instr(hay, n.lower()) > 0), needles, F.lit(False))


def score_floor(matches: DataFrame, least: float) -> DataFrame:
    """Applied only above 0, so that unscored rows stay without a floor."""
    return matches.where(F.col("score") >= least) if least > 0 else matches


def equalities(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Each given value must be equal; empty ones are no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, wanted.items(), df)


def recent(jobs: DataFrame, now: int, days: int) -> DataFrame:
    return jobs.where(F.coalesce("posted_at", "first_seen") >= now - min(max(days, 1), 3650) * DAY_MS)


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> Column:
    return F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])


def remote_open(country: str | None) -> Column:
    """Remote and open to the country: no regions named, everywhere, or the country itself. Without a country any remote opening."""
    remote = F.col("remote_mode") == "remote"
    if country is None:
        return remote
    r = F.coalesce(F.col("remote_regions"), F.array().cast("array<string>"))
    return remote & ((F.size(r) == 0) | F.array_contains(r, "global") | F.array_contains(r, country))


def place(box: tuple[float, float, float, float], country: str | None) -> Column:
    """In the box; or without coordinates in the country; or remote and open to it."""
    inside = in_box("lat", "lon", box)
    near = inside | (F.col("lat").isNull() & (F.col("country_code") == country)) if country else inside
    return near | remote_open(country)


def tri_state(domains: DataFrame, jobs: DataFrame, has_jobs: bool | None = None, has_careers: bool | None = None) -> DataFrame:
    """Each of the two: true, false or no filter."""
    if has_careers is not None:
        domains = domains.where("careers_url is not null" if has_careers else "careers_url is null")
    if has_jobs is None:
        return domains
    ids = open_jobs(jobs).where("domain_id is not null").select(F.col("domain_id").alias("id")).distinct()
    return domains.join(ids, "id", "left_semi" if has_jobs else "left_anti")


def status(domains: DataFrame, wanted: str | None) -> DataFrame:
    return domains if wanted in (None, "", "all") else domains.where(F.col("status") == wanted)


def discovered(domains: DataFrame, include: bool, column: str = "status") -> DataFrame:
    return domains if include else domains.where(F.col(column) != "discovered")


def as_of(t: int) -> Column:
    """Seen by then and not closed yet."""
    return (F.col("first_seen") <= t) & (F.col("closed_at").isNull() | (F.col("closed_at") > t))


def shown() -> Column:
    """The company's name as typed, else the site's name, else its host."""
    return F.coalesce("company", "name", "host")


def shared_content(pages: DataFrame) -> DataFrame:
    """Pages whose content another url of the domain has too: more than one url in the content's aggregate."""
    p = pages.where("content_hash is not null and domain_id is not null")
    many = p.groupBy("domain_id", "content_hash").agg(F.min("url").alias("a"), F.max("url").alias("b")).where("a <> b").drop("a", "b")
    return p.join(many, ["domain_id", "content_hash"], "left_semi")


def nearest_km(lat: str, lon: str, spots: Sequence[tuple[float, float]]) -> Column:
    """Distance to the nearest of a few fixed places."""
    return F.array_min(F.array(*[distance_km(F.col(lat), F.col(lon), F.lit(float(a)), F.lit(float(b))) for a, b in spots]))


def count_given(columns: Sequence[str]) -> Column:
    return reduce(lambda a, c: a + F.col(c).isNotNull().cast("int"), columns, F.lit(0))

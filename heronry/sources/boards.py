"""Job-board listings: JSON payloads of three vendors as postings, by a typed schema and expressions only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.measures import datetime_ms
from heronry.functions.text import clean, employment_type, remote_mode, salary_period
from heronry.functions.urls import normalize

#: Where each vendor's listing is.
API = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true&pay_transparency=true",
    "lever": "https://api.lever.co/v0/postings/{}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true",
}
_GREENHOUSE = """struct<jobs: array<struct<id: bigint, title: string, absolute_url: string, location: struct<name: string>, departments: array<struct<name: string>>, first_published: string, updated_at: string,
  content: string, company_name: string, pay_input_ranges: array<struct<min_cents: double, max_cents: double, currency_type: string, title: string>>>>>"""
_LEVER = """array<struct<id: string, text: string, hostedUrl: string, categories: struct<location: string, team: string, department: string, commitment: string>, createdAt: bigint, workplaceType: string, country: string,
  descriptionPlain: string, salaryRange: struct<min: double, max: double, currency: string, interval: string>>>"""
_ASHBY = """struct<jobs: array<struct<id: string, title: string, jobUrl: string, location: string, department: string, team: string, employmentType: string, workplaceType: string, isRemote: boolean, isListed: boolean,
  publishedAt: string, descriptionPlain: string, address: struct<postalAddress: struct<addressCountry: string>>,
  compensation: struct<summaryComponents: array<struct<compensationType: string, interval: string, currencyCode: string, minValue: double, maxValue: double>>>>>>"""
#: Fixed value: characters of a description that are kept.
MOST_DESCRIPTION = 20_000
COLUMNS = ("url", "external_id", "title", "company", "location", "country_code", "remote_mode", "department", "employment_type", "posted_at", "description", "salary_min", "salary_max", "salary_currency", "salary_period", "source")


def api_url(vendor: Column, token: Column) -> Column:
    """Where a board's listing is; null for vendors without one."""
    out = None
    for v, t in API.items():
        a, b = t.split("{}")
        c = F.concat(F.lit(a), token, F.lit(b))
        out = F.when(vendor == v, c) if out is None else out.when(vendor == v, c)
    return out


def posting_url(c: Column) -> Column:
    """A posting's address, normalised; null for what isn't http(s)."""
    return F.when(F.trim(c).rlike("(?i)^https?://[^/]"), normalize(F.trim(c)))


def country(c: Column) -> Column:
    """A two-letter country code in upper case; null for others."""
    v = F.upper(F.trim(c))
    return F.when(v.rlike("^[A-Z]{2}$"), v)


def plain_html(c: Column) -> Column:
    """Visible text of HTML, perhaps escaped as a whole, up to 20,000 characters; null stays null. Read by the parser of pages, in Arrow batches."""

    def read(texts: pd.Series) -> pd.Series:
        from heronry.sources.pages import visible_text

        return texts.map(lambda t: visible_text(t)[:MOST_DESCRIPTION] if isinstance(t, str) else None)

    return F.pandas_udf(read, "string")(c)


def _out(rows: DataFrame, keep: list[str], source: str, **given: Column) -> DataFrame:
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    defaults = {c: num if c in ("salary_min", "salary_max") else F.lit(None).cast("long") if c == "posted_at" else text for c in COLUMNS}
    cols = defaults | given | {"source": F.lit(source)}
    return rows.select(*keep, *[cols[c].alias(c) for c in COLUMNS]).where("url is not null and title is not null")


def parse(payloads: DataFrame, vendor: str, column: str = "body") -> DataFrame:
    """Postings of each payload row, with the row's other columns. Bad JSON, postings without a title or an http address and unlisted ones give nothing."""
    keep = [c for c in payloads.columns if c != column]
    if vendor == "greenhouse":
        p = payloads.select(*keep, F.explode(F.from_json(column, _GREENHOUSE)["jobs"]).alias("p"))
        g = lambda n: F.col(f"p.{n}")
        pay, place = F.get(g("pay_input_ranges"), F.lit(0)), clean("p.location.name")
        hourly = F.contains(F.lower(F.coalesce(pay["title"], F.lit(""))), F.lit("hour"))
        return _out(
            p, keep, "ats:greenhouse", url=posting_url(g("absolute_url")), external_id=g("id").cast("string"), title=clean("p.title"), company=clean("p.company_name"), location=place,
            remote_mode=F.when(F.contains(F.lower(place), F.lit("remote")), "remote"), department=F.get(F.filter(F.transform(g("departments"), lambda d: clean(d["name"])), lambda x: x.isNotNull()), F.lit(0)),
            posted_at=datetime_ms(F.coalesce(g("first_published"), g("updated_at"))), description=F.nullif(plain_html(g("content")), F.lit("")), salary_min=pay["min_cents"] / 100, salary_max=pay["max_cents"] / 100,
            salary_currency=clean(pay["currency_type"]), salary_period=F.when(pay.isNotNull(), F.when(hourly, "hour").otherwise("year")),
        )
    if vendor == "lever":
        p = payloads.select(*keep, F.explode(F.from_json(column, _LEVER)).alias("p"))
        g = lambda n: F.col(f"p.{n}")
        return _out(
            p, keep, "ats:lever", url=posting_url(g("hostedUrl")), external_id=g("id"), title=clean("p.text"), location=clean("p.categories.location"), department=F.coalesce(clean("p.categories.team"), clean("p.categories.department")),
            employment_type=employment_type("p.categories.commitment"), remote_mode=remote_mode("p.workplaceType"), country_code=country(g("country")), salary_min=g("salaryRange.min"), salary_max=g("salaryRange.max"),
            salary_currency=clean("p.salaryRange.currency"), salary_period=salary_period("p.salaryRange.interval"), posted_at=g("createdAt"), description=F.substring(clean("p.descriptionPlain"), 1, 20_000),
        )
    if vendor == "ashby":
        p = payloads.select(*keep, F.explode(F.from_json(column, _ASHBY)["jobs"]).alias("p")).where("coalesce(p.isListed, true)")
        g = lambda n: F.col(f"p.{n}")
        pay = F.get(F.filter(g("compensation.summaryComponents"), lambda c: c["compensationType"] == "Salary"), F.lit(0))
        return _out(
            p, keep, "ats:ashby", url=posting_url(g("jobUrl")), external_id=g("id"), title=clean("p.title"), location=clean("p.location"), department=F.coalesce(clean("p.department"), clean("p.team")), employment_type=employment_type("p.employmentType"),
            remote_mode=F.coalesce(remote_mode("p.workplaceType"), F.when(g("isRemote"), "remote")), country_code=country(g("address.postalAddress.addressCountry")), salary_min=pay["minValue"], salary_max=pay["maxValue"],
            salary_currency=clean(pay["currencyCode"]), salary_period=salary_period(pay["interval"]), posted_at=datetime_ms(g("publishedAt")), description=F.substring(clean("p.descriptionPlain"), 1, 20_000),
        )
    raise ValueError(f"no listing is known for {vendor}")

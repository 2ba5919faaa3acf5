"""Browsing companies and one domain in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import contains_any
from heronry.operators import filters as P
from heronry.operators.aggregates import counts
from heronry.operators.topk import domain_pages, with_open_count


def companies(domains: DataFrame, jobs: DataFrame, pages: DataFrame, boards: DataFrame | None = None, q: str = "", status: str | None = None, has_jobs: bool | None = None, has_careers: bool | None = None, vendor: str | None = None, sort: str = "jobs", desc: bool = True, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total, page): how many companies fit, and one page of them with counts. Sorts: host, name, score, jobs, first_seen; ties by host."""
    d = P.tri_state(P.status(domains, status), jobs, has_jobs, has_careers)
    if q.strip():
        d = d.where(contains_any(["host", "name", "industry"], q.strip()))
    if vendor:
        d = d.join(boards.where(F.col("vendor") == vendor).select(F.col("domain_id").alias("id")).distinct(), "id", "left_semi")
    total = d.agg(F.count("*").alias("total"))
    d = with_open_count(d, jobs)
    by = {"host": F.lower("host"), "name": F.lower(F.coalesce("name", "host")), "score": F.col("company_score"), "jobs": F.col("open_jobs"), "first_seen": F.col("first_seen")}[sort]
    order = F.desc_nulls_last(by) if desc else F.asc_nulls_last(by)
    page = d.orderBy(order, F.lower("host"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))
    n = pages.groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("pages"))
    out = page.join(n, "id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return total, out.select("id", "host", "name", "status", "industry", "company_score", "careers_url", "open_jobs", "pages")


def domain_detail(domains: DataFrame, pages: DataFrame, jobs: DataFrame, boards: DataFrame, edges: DataFrame, host: str, most: int = 100) -> dict[str, DataFrame]:
    """domain, pages, jobs, boards and counts of one host; all empty for an unknown one. Everything is joined lazily by the domain's row."""
    d = domains.where(F.col("host") == host)
    key = d.select(F.col("id").alias("domain_id"))
    mine = lambda df: df.join(key, "domain_id", "left_semi")
    own = mine(pages)
    listed = own.orderBy(F.desc_nulls_last(F.col("kind") == "careers"), F.desc_nulls_last(F.col("kind") == "home"), "id").limit(most)
    open_ = mine(jobs)
    inbound = edges.join(key.withColumnRenamed("domain_id", "dst_domain_id"), "dst_domain_id", "left_semi")
    outbound = edges.join(key.withColumnRenamed("domain_id", "src_domain_id"), "src_domain_id", "left_semi")
    return {
        "domain": d,
        "pages": listed,
        "jobs": open_.orderBy(F.desc_nulls_last("posted_at"), "id").limit(most),
        "boards": mine(boards).orderBy("key"),
        "counts": counts(pages=own, open_jobs=open_.where("closed_at is null"), inbound=inbound, outbound=outbound),
    }


__all__ = ["companies", "domain_detail", "domain_pages"]

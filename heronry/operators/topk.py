"""Orders with a limit (top-k, never a full sort), paging and joins to one best row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import simplify
from heronry.functions.urls import depth


def ordered(df: DataFrame, sort: str, limit: int) -> DataFrame:
    """Postings by recent, salary_desc, match or relevance; ids break ties, the newest first."""
    by = {
        "recent": [F.desc_nulls_last(F.coalesce("posted_at", "first_seen"))],
        "salary_desc": [F.desc_nulls_last("salary_usd_annual")] if "salary_usd_annual" in df.columns else [],
        "match": [F.desc_nulls_last("match_score")] if "match_score" in df.columns else [],
        "relevance": [F.desc_nulls_last("relevance")] if "relevance" in df.columns else [],
    }[sort]
    return df.orderBy(*by, F.desc("id")).limit(limit)


def with_domain(jobs: DataFrame, domains: DataFrame) -> DataFrame:
    d = domains.select(F.col("id").alias("domain_id"), "host", "name", "industry")
    return jobs.join(d, "domain_id", "left")


def with_open_count(domains: DataFrame, jobs: DataFrame) -> DataFrame:
    n = jobs.where("closed_at is null and domain_id is not null").groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("open_jobs"))
    return domains.join(n, "id", "left").withColumn("open_jobs", F.coalesce("open_jobs", F.lit(0)))


def with_best_anchor(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Each url with the anchor of its best-scored link. An aggregate, joined; nothing correlated is left."""
    best = links.where("link_score is not null").groupBy(F.col("dst_url").alias("url")).agg(F.min_by("anchor", F.struct(-F.col("link_score"), "src_page_id", "anchor")).alias("anchor"))
    return frontier.join(best, "url", "left")


def attribute_boards(boards: DataFrame, domains: DataFrame) -> DataFrame:
    """(key, domain_id): the domain a board belongs to: its name, else the first label of its host, is the token; companies before probing ones, then the smallest id."""
    d = domains.where("status in ('company', 'probing')").select("id", simplify(F.coalesce("name", F.lit(""))).alias("n"), simplify(F.substring_index("host", ".", 1)).alias("l"), F.when(F.col("status") == "company", 0).otherwise(1).alias("p"))
    # two equality joins instead of one with OR
    names = d.select("id", "p", F.explode(F.array(F.struct(F.col("n").alias("t"), F.lit(0).alias("stage")), F.struct(F.col("l").alias("t"), F.lit(1).alias("stage")))).alias("x")).select("id", "p", "x.t", "x.stage").where("t <> ''")
    met = boards.select("key", simplify("token").alias("t")).join(names, "t")
    return met.groupBy("key").agg(F.min(F.struct("stage", "p", "id")).alias("m")).select("key", F.col("m.id").alias("domain_id"))


def domain_pages(pages: DataFrame, domain_id: int, limit: int) -> DataFrame:
    p = pages.where(F.col("domain_id") == domain_id)
    return p.orderBy(F.desc_nulls_last(F.col("kind") == "careers"), F.desc_nulls_last(F.col("kind") == "home"), "id").limit(limit)


def graph_pages(pages: DataFrame, domain_id: int, limit: int) -> DataFrame:
    p = pages.where(F.col("domain_id") == domain_id)
    return p.orderBy(*[F.desc_nulls_last(F.col("kind") == k) for k in ("home", "careers", "job")], "id").limit(limit)


def keyset(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows after a key: the filter reaches the scan, the limit is a top-k."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def has_more(page: DataFrame, limit: int) -> DataFrame:
    """Whether a page is full; a last page that just fits counts as full."""
    return page.agg((F.count("*") == limit).alias("has_more"))


def enrichment_queue(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.where("category is null or seniority is null").orderBy(F.desc(F.col("category").isNull()), "id").limit(limit)


def shallowest(pages: DataFrame, limit: int) -> DataFrame:
    """(url): the shallowest, then shortest different urls."""
    return pages.select("url").distinct().orderBy(depth("url"), F.length("url"), "url").limit(limit)

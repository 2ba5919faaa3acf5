"""Graphs of domains and of a domain's pages, live and as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.urls import host, page_label, registrable_domain
from heronry.operators.aggregates import counts, degree
from heronry.operators.filters import as_of, discovered
from heronry.operators.timeline import status_at

FOREVER = 2**62


def ranked_nodes(domains: DataFrame, pages: DataFrame, jobs: DataFrame, edges: DataFrame, log: DataFrame | None, at: int | None, include_discovered: bool) -> DataFrame:
    """Every domain with status, pages, jobs and degree at a time, and its rank value. Each side is aggregated before it is joined."""
    t = FOREVER if at is None else at
    pc = pages.where(F.col("fetched_at") <= t).groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("pages"))
    jc = jobs.where(as_of(t) & F.col("domain_id").isNotNull()).groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("jobs"))
    dg = degree(edges.where(F.col("first_seen") <= t)).withColumnRenamed("n", "degree")
    d = domains.where(F.col("first_seen") <= t)
    if at is not None:
        cls = status_at(log, at).withColumnRenamed("status", "then").withColumnRenamed("host", "h")
        d = d.join(cls, F.col("host") == F.col("h"), "left").withColumn("status", F.coalesce("then", F.lit("discovered"))).drop("then", "h")
    d = discovered(d, include_discovered)
    for side in (pc, jc, dg):
        d = d.join(side, "id", "left")
    d = d.fillna(0, ["pages", "jobs", "degree"])
    return d.withColumn("rank_value", F.col("pages") * 3 + F.col("jobs") + F.col("degree"))


def node_page(nodes: DataFrame, limit: int, offset: int) -> DataFrame:
    """The nodes from `offset` on, `limit` at most, by rank value, then id: a top-k of offset + limit rows."""
    return nodes.orderBy(F.desc("rank_value"), "id").offset(offset).limit(limit).select("id", "host", "name", "status", "company_score", "careers_url", "pages", "jobs", "degree")


def edges_between(edges: DataFrame, shown: DataFrame, page: DataFrame) -> DataFrame:
    """Edges between domains shown so far, of which at least one end is on the page."""
    mark = shown.join(page.select("id").withColumn("on", F.lit(True)), "id", "left")
    s, d = mark.select(F.col("id").alias("src_domain_id"), F.col("on").alias("s_on")), mark.select(F.col("id").alias("dst_domain_id"), F.col("on").alias("d_on"))
    return edges.join(s, "src_domain_id").join(d, "dst_domain_id").where("s_on or d_on").drop("s_on", "d_on")


def domain_graph(domains: DataFrame, pages: DataFrame, jobs: DataFrame, edges: DataFrame, log: DataFrame | None = None, limit: int = 200, offset: int = 0, include_discovered: bool = True, at: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of one page of the graph, live or as of `at` (then `log` has the classifications)."""
    limit, offset, t = min(max(limit, 1), 10_000), max(offset, 0), FOREVER if at is None else at
    nodes = ranked_nodes(domains, pages, jobs, edges, log, at, include_discovered)
    page = node_page(nodes, limit, offset)
    shown = node_page(nodes, limit + offset, 0).select("id")
    links = edges_between(edges.where(F.col("first_seen") <= t), shown, page).select(F.col("src_domain_id").alias("source"), F.col("dst_domain_id").alias("target"), "weight")
    companies = domains.where("status = 'company'") if at is None else status_at(log, at).where("status = 'company'")
    total = counts(domains=domains.where(F.col("first_seen") <= t), companies=companies, pages=pages.where(F.col("fetched_at") <= t), open_jobs=jobs.where(as_of(t)))
    return page, links, total


def neighbourhood(edges: DataFrame, node: int) -> DataFrame:
    """(id): a node and its neighbours in both directions."""
    near = edges.where((F.col("src_domain_id") == node) | (F.col("dst_domain_id") == node))
    return near.select(F.explode(F.array("src_domain_id", "dst_domain_id", F.lit(node).cast("long"))).alias("id")).distinct()


def page_graph(pages: DataFrame, links: DataFrame, frontier: DataFrame, domain_id: int, domain: str, most_pages: int = 500, most_pending: int = 200, most_external: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a domain's pages: fetched and failed ones, links waiting to be fetched, and other sites with their counts.

    Nodes: key, label, kind, state. Edges: source, target, n. Pending ones are the first in order of page and url.
    """
    from heronry.operators.topk import graph_pages

    own = graph_pages(pages, domain_id, most_pages).select("id", "url", "kind", "error")
    out = own.select(F.col("id").alias("src_page_id"), F.col("url").alias("src_url")).join(links, "src_page_id")
    inside = registrable_domain("dst_url") == domain
    known = own.select(F.col("url").alias("dst_url"), F.lit(True).alias("fetched"))
    out = out.join(known, "dst_url", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    waiting = out.where("inside and fetched is null").groupBy("dst_url").agg(F.min("src_page_id").alias("first")).orderBy("first", "dst_url").limit(most_pending).select("dst_url")
    states = frontier.select(F.col("url").alias("dst_url"), "state")
    pending = waiting.join(states, "dst_url", "left")
    sites = out.where("not inside").withColumn("site", host("dst_url"))
    top = sites.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(most_external)
    nodes = (
        own.select(F.col("url").alias("key"), page_label("url").alias("label"), F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("kind")).alias("kind"), F.lit(None).cast("string").alias("state"))
        .unionByName(pending.select(F.col("dst_url").alias("key"), page_label("dst_url").alias("label"), F.lit("pending").alias("kind"), "state"))
        .unionByName(top.select(F.col("site").alias("key"), F.col("site").alias("label"), F.lit("external").alias("kind"), F.lit(None).cast("string").alias("state")))
    )
    edges = (
        out.where("fetched").select(F.col("src_url").alias("source"), F.col("dst_url").alias("target"))
        .unionByName(out.where("inside and fetched is null").join(waiting, "dst_url", "left_semi").select(F.col("src_url").alias("source"), F.col("dst_url").alias("target")))
        .unionByName(sites.join(top.select("site"), "site", "left_semi").select(F.col("src_url").alias("source"), F.col("site").alias("target")))
    )
    return nodes, edges.groupBy("source", "target").agg(F.count("*").alias("n"))

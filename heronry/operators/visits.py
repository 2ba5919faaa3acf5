"""Recording visits and listings: the changes of one pass to several tables at once, and the events that tell of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.operators.merge import close_missing, enqueue, fold_domains, insert_missing, latest_per_key, replace, upsert_jobs


def classify_update(domains: DataFrame, pages: DataFrame) -> DataFrame:
    """Domains after the assessments of pages, as `fold_domains` tells; a home page's name wins over the first one found. home_seen is kept where `domains` has it, score_reasons where a page is as good as the best before.

    `pages`: domain_id, id, score, parked, conclusive, home, reasons, name.
    """
    seen = F.col("home_seen") if "home_seen" in domains.columns else F.lit(False)
    f = fold_domains(pages, domains.select(F.col("id").alias("domain_id"), "status", "company_score", seen.alias("home_seen")))
    f = f.select(F.col("domain_id").alias("id"), F.col("best_score").alias("__best"), F.col("status").alias("__status"), F.to_json("reasons").alias("__reasons"), F.col("home_seen").alias("__seen"))
    home = F.max_by("name", F.when(F.col("home") & F.col("name").isNotNull(), F.col("id")))
    first = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("id")))
    names = pages.groupBy(F.col("domain_id").alias("id")).agg(home.alias("__home"), first.alias("__first"))
    j = domains.join(f, "id", "left").join(names, "id", "left")
    new = {"company_score": F.coalesce("__best", "company_score"), "status": F.coalesce("__status", "status"), "name": F.coalesce("__home", "name", "__first"), "home_seen": F.coalesce("__seen", seen), "score_reasons": F.coalesce("__reasons", *[c for c in ("score_reasons",) if c in domains.columns])}
    return j.withColumns(new).select(*domains.columns)


def record(pages: DataFrame, domains: DataFrame, visits: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, domains, events) after visits (url, host, kind, http_status, content_hash, error): the last visit of a url counts, new hosts become
    discovered domains, content that another page of the host has is a duplicate. All three come from one plan over the same snapshot."""
    last = latest_per_key(visits, ["url"], [F.col("seq")])
    known = domains.select("host")
    fresh = last.select("host").distinct().join(known, "host", "left_anti").withColumn("status", F.lit("discovered")).withColumn("first_seen", F.lit(now))
    doms = domains.unionByName(fresh, allowMissingColumns=True)
    first = pages.where("content_hash is not null").groupBy("host", "content_hash").agg(F.min("url").alias("first_url"))
    marked = last.join(first, ["host", "content_hash"], "left")
    kind = F.when(F.col("first_url").isNotNull() & (F.col("first_url") != F.col("url")), "duplicate").otherwise(F.col("kind"))
    rows = marked.withColumn("kind", kind).withColumn("fetched_at", F.lit(now)).drop("first_url", "seq")
    name = F.when(F.col("error").isNotNull(), "fetch_failed").otherwise("page_fetched")
    events = rows.select(F.lit(now).alias("ts"), name.alias("kind"), F.to_json(F.struct("url", "http_status", "error")).alias("payload"))
    return replace(pages, rows, ["url"]), doms, events


def domain_id(host: Column) -> Column:
    """The id of a domain that is seen first: a number of its host, so that it's the same wherever it's made."""
    return F.abs(F.xxhash64(host) % (2**62))


def record_links(pages: DataFrame, domains: DataFrame, page_links: DataFrame, edges: DataFrame, frontier: DataFrame, now: int, most: int = 500) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(domains, page_links, edges, frontier) after the links of pages (page_id, domain, depth, links: structs url, text, target, score) were found.

    Of a page's links the first `most` count (the reference's bound); each is kept once a page. Other domains that are linked to become known, and the edge from the page's domain to each gets one more for every link; links with a
    score are queued, one deeper, and raise the score of those that wait. `target` is null for blocked sites and what has no domain.
    """
    each = pages.select("page_id", "domain", "depth", F.posexplode(F.slice("links", 1, most)).alias("pos", "l")).select("page_id", "domain", "depth", "pos", "l.*")
    outside = each.where("target is not null and target <> domain")
    hosts = each.select(F.col("domain").alias("host")).unionByName(outside.select(F.col("target").alias("host"))).distinct()
    new = hosts.join(domains.select("host"), "host", "left_anti").select(domain_id(F.col("host")).alias("id"), "host", F.lit("discovered").alias("status"), F.lit(now).alias("first_seen"))
    doms = domains.unionByName(new, allowMissingColumns=True)
    ids = doms.select("id", "host")
    pairs = outside.groupBy("domain", "target").agg(F.count("*").alias("n"))
    src, dst = ids.select(F.col("id").alias("src_domain_id"), F.col("host").alias("domain")), ids.select(F.col("id").alias("dst_domain_id"), F.col("host").alias("target"))
    more = pairs.join(src, "domain").join(dst, "target").select("src_domain_id", "dst_domain_id", F.col("n").alias("weight"), F.lit(now).alias("first_seen"))
    after = edges.select("src_domain_id", "dst_domain_id", "weight", "first_seen").unionByName(more).groupBy("src_domain_id", "dst_domain_id").agg(F.sum("weight").alias("weight"), F.min("first_seen").alias("first_seen"))
    found = each.groupBy(F.col("page_id").alias("src_page_id"), F.col("url").alias("dst_url")).agg(F.min_by(F.struct(F.col("text").alias("anchor"), F.col("score").alias("link_score")), "pos").alias("r")).select("src_page_id", "dst_url", "r.*")
    links = insert_missing(page_links, found, ["src_page_id", "dst_url"])
    queue = enqueue(frontier, each.where("score is not null").select("url", "score", (F.col("depth") + 1).alias("depth")))
    return doms, links, after, queue


def record_board(jobs: DataFrame, listing: DataFrame, board_key: str, domain_id: int | None, now: int) -> tuple[DataFrame, DataFrame]:
    """(jobs, event) after a board's listing: postings refreshed or added, missing ones closed; the event has total, new and closed."""
    seen = listing.withColumn("board_key", F.lit(board_key)).withColumn("domain_id", F.lit(domain_id).cast("long"))
    up = upsert_jobs(jobs, seen, now)
    after = close_missing(up, listing, board_key, now)
    gone = (F.col("closed_at") == now) & (F.col("board_key") == board_key)
    event = after.agg(F.count_if(F.col("last_seen") == now).alias("total"), F.count_if(F.col("is_new")).alias("new"), F.count_if(F.coalesce(gone, F.lit(False))).alias("closed"))
    return after.drop("is_new", "unchanged"), event.select(F.lit(now).alias("ts"), F.lit("jobs_found").alias("kind"), F.lit(board_key).alias("board"), "total", "new", "closed")


def append(rows: DataFrame, folder: str) -> None:
    """Events and samples are only ever added."""
    rows.write.mode("append").parquet(folder)

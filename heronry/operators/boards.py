"""Job boards: which company's a board is, by the pages that show it, and how boards change, as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import urls as U
from heronry.operators.merge import insert_missing


def attributed(pages: DataFrame) -> DataFrame:
    """(id, key, vendor, token, host, source) of each page (id, domain, links: structs url and text, embeds: urls) that shows its company's board; source is embed or link.

    Embedded boards come first: the first whose token can name the domain, else the only one. Then linked ones: the first that can name it, else the only one, if a link to it says
    careers. Pages with several other boards, of a portfolio say, give none. Boards are told per url and combined by page before the shuffle; null arrays are empty.
    """
    none = F.array().cast("array<struct<kind:int,url:string,text:string>>")
    linked = F.transform("links", lambda x: F.struct(F.lit(1).alias("kind"), x["url"].alias("url"), x["text"].alias("text")))
    embedded = F.transform("embeds", lambda u: F.struct(F.lit(0).alias("kind"), u.alias("url"), F.lit(None).cast("string").alias("text")))
    each = pages.select("id", "domain", F.posexplode(F.concat(F.coalesce(embedded, none), F.coalesce(linked, none))).alias("pos", "u")).select("id", "domain", "pos", "u.*")
    found = each.withColumn("b", U.board("url")).where("b is not null").withColumn("key", F.concat("b.vendor", F.lit("/"), "b.token"))
    found = found.withColumn("own", F.coalesce(U.matches_domain(F.col("b.token"), F.col("domain")), F.lit(False))).withColumn("said", (F.col("kind") == 1) & U.careers_match("url", "text")["in_anchor"])
    per = found.groupBy("id", "kind", "key").agg(F.min("pos").alias("pos"), F.first("b").alias("b"), F.first("own").alias("own"), F.max("said").alias("said"))
    board = F.struct("pos", "key", "b", "said")
    one = per.groupBy("id", "kind").agg(F.min(F.when(F.col("own"), board)).alias("own"), F.min(board).alias("only"), F.count("*").alias("n"))
    sole = F.when((F.col("n") == 1) & ((F.col("kind") == 0) | F.col("only.said")), F.col("only"))
    pick = one.withColumn("p", F.coalesce("own", sole)).where("p is not null").groupBy("id").agg(F.min_by(F.struct("kind", "p"), "kind").alias("r"))
    return pick.select("id", "r.p.key", "r.p.b.vendor", "r.p.b.token", "r.p.b.host", F.when(F.col("r.kind") == 0, "embed").otherwise("link").alias("source"))


def ensured(boards: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """`boards` with those of `seen` (key, vendor, token, host) that it lacks."""
    return insert_missing(boards, seen.withColumn("first_seen", F.lit(now)), ["key"])


def attached(boards: DataFrame, jobs: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boards, jobs) after boards were found to belong to domains (key, domain_id): postings of a board that have no domain get it, others keep theirs."""
    o = owners.dropDuplicates(["key"]).select(F.col("key").alias("__k"), F.col("domain_id").alias("__d"))
    b = boards.join(o, F.col("key") == F.col("__k"), "left").withColumn("domain_id", F.coalesce("__d", "domain_id")).select(*boards.columns)
    j = jobs.join(o, F.col("board_key") == F.col("__k"), "left").withColumn("domain_id", F.coalesce("domain_id", "__d")).select(*jobs.columns)
    return b, j


def detached(boards: DataFrame, domains: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boards, domains) after attributions (key) were taken back: a domain whose ats and ats_token are the board's loses them, and its careers_url where that names vendor and token."""
    gone = keys.select(F.col("key").alias("__k")).distinct()
    b = boards.join(gone, F.col("key") == F.col("__k"), "left")
    was = b.where("__k is not null and domain_id is not null").select(F.col("domain_id").alias("__d"), F.col("vendor").alias("__v"), F.col("token").alias("__t")).distinct()
    d = domains.join(was, (F.col("id") == F.col("__d")) & (F.col("ats") == F.col("__v")) & (F.col("ats_token") == F.col("__t")), "left")
    hit = F.col("__d").isNotNull()
    named = hit & F.coalesce(F.contains(F.lower("careers_url"), F.lower("__v")) & F.contains(F.lower("careers_url"), F.lower("__t")), F.lit(False))
    off = {"ats": F.when(~hit, F.col("ats")), "ats_token": F.when(~hit, F.col("ats_token")), "careers_url": F.when(~named, F.col("careers_url"))}
    return b.withColumn("domain_id", F.when(F.col("__k").isNull(), F.col("domain_id"))).select(*boards.columns), d.withColumns(off).select(*domains.columns)


def fetched(boards: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """`boards` after listings were fetched (key, status, job_count, name): time and status always, count and name where given."""
    r = results.dropDuplicates(["key"]).select(F.col("key").alias("__k"), F.col("status").alias("__s"), F.col("job_count").alias("__n"), F.col("name").alias("__name"), F.lit(now).alias("__at"))
    j = boards.join(r, F.col("key") == F.col("__k"), "left")
    new = {"last_fetched": F.coalesce("__at", "last_fetched"), "last_status": F.coalesce("__s", "last_status"), "job_count": F.coalesce("__n", "job_count"), "name": F.coalesce("__name", "name")}
    return j.withColumns(new).select(*boards.columns)

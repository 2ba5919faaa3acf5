"""The event log over time: status at a time, runs, activity, events and the crawler's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.measures import bucket_ms, bucket_start

#: What each kind of event belongs to in a feed.
FEED = {
    "jobs_found": "jobs", "jobs_enriched": "jobs", "careers_found": "careers", "domain_classified": "classify", "fetch_failed": "errors",
    "crawler_started": "crawler", "crawler_stopped": "crawler", "seeds_loaded": "crawler", "control_applied": "crawler", "profile_changed": "crawler", "page_fetched": "crawler",
}
STALE_MS = 15_000


def status_at(log: DataFrame, t: int) -> DataFrame:
    """(host, status): each host's last classification at or before a time."""
    return log.where((F.col("kind") == "domain_classified") & (F.col("ts") <= t)).groupBy("host").agg(F.max_by("status", "id").alias("status"))


def activity(log: DataFrame, start: int, width: int) -> DataFrame:
    """(t, pages, new_jobs) of each bucket with any."""
    rows = log.where(F.col("kind").isin("page_fetched", "jobs_found"))
    return rows.groupBy(bucket_start("ts", start, width).alias("t")).agg(F.count_if(F.col("kind") == "page_fetched").alias("pages"), F.coalesce(F.sum(F.when(F.col("kind") == "jobs_found", F.col("new"))), F.lit(0)).alias("new_jobs"))


def history(log: DataFrame, buckets: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(runs, activity in buckets from the first event on). The first event's time is one small number."""
    from heronry.operators.sequences import pair_runs

    start = log.agg(F.min("ts")).first()[0]
    if start is None:
        return pair_runs(log), activity(log, 0, 1000)
    return pair_runs(log), activity(log, start, bucket_ms(start, now, min(max(buckets, 1), 2000)))


def events(log: DataFrame, after: int | None = None, before: int | None = None, limit: int = 200) -> DataFrame:
    """Events after an id in order, else the last before a time, else the last; always the oldest first."""
    limit = min(max(limit, 1), 2000)
    if after is not None:
        return log.where(F.col("id") > after).orderBy("id").limit(limit)
    rows = log if before is None else log.where(F.col("ts") <= before)
    return rows.orderBy(F.desc("id")).limit(limit).orderBy("id")


def feed(log: DataFrame, newest: int = 300) -> DataFrame:
    """(id, kind, category) of the newest events."""
    kinds = F.create_map(*[F.lit(x) for kv in FEED.items() for x in kv])
    return log.orderBy(F.desc("id")).limit(newest).select("id", "kind", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("crawler")).alias("category"))


def crawler_status(log: DataFrame, samples: DataFrame, now: int, stale_ms: int = STALE_MS) -> DataFrame:
    """One row: running (started last, and a fresh sample), paused (the last pause or resume since the start is a pause; with a `command` in the log), and the last start and stop."""
    command = F.col("command") if "command" in log.columns else F.lit(None).cast("string")
    asked = (F.col("kind") == "control_applied") & command.isin("pause", "resume")
    marks = log.agg(
        F.max(F.when(F.col("kind") == "crawler_started", F.col("id"))).alias("last_start"), F.max(F.when(F.col("kind") == "crawler_stopped", F.col("id"))).alias("last_stop"), F.max(F.when(asked, F.struct("id", command.alias("c")))).alias("asked"),
    )
    fresh = samples.agg(F.max("ts").alias("last_sample"))
    started = F.col("last_start").isNotNull() & (F.col("last_start") > F.coalesce("last_stop", F.lit(-1)))
    both = marks.crossJoin(fresh).withColumn("running", F.coalesce(started & (F.col("last_sample") >= now - stale_ms), F.lit(False)))  # one row each
    held = F.col("running") & (F.col("asked.c") == "pause") & (F.col("asked.id") > F.col("last_start"))
    return both.withColumn("paused", F.coalesce(held, F.lit(False))).drop("asked")


def stop_at_bytes(samples: DataFrame, most: int) -> DataFrame:
    """(run_id, stop_id): the first sample of each run that reached a data cap."""
    return samples.where(F.col("bytes") >= most).groupBy("run_id").agg(F.min("id").alias("stop_id"))

"""Windows over ordered rows: first per group, rates, runs, gaps and merged ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.measures import grown


def best_per_host(frontier: DataFrame, limit: int, exclude: Sequence[str] = ()) -> DataFrame:
    """The queued url of the highest score of each host (then the earliest), and of these the best `limit`.

    The window keeps one row a host, which Spark also applies before the shuffle; the limit is a top-k, not a sort.
    """
    w = Window.partitionBy("host").orderBy(F.desc("score"), "enqueued_at", "url")
    q = frontier.where("state = 'queued'")
    if exclude:
        q = q.where(~F.col("host").isin(*exclude))
    return q.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").orderBy(F.desc("score"), "enqueued_at", "url").limit(limit)


def rates(samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """id, ts, run_id and the rate a second of each counter since the run's sample before; null at its first, never negative."""
    w = Window.partitionBy("run_id").orderBy("id")
    secs = (F.col("ts") - F.lag("ts").over(w)) / 1000.0
    out = [F.when(secs > 0, grown(F.col(c) - F.lag(c).over(w)) / secs).alias(f"{c}_per_sec") for c in counters]
    return samples.select("id", "ts", "run_id", *out)


def pair_runs(log: DataFrame) -> DataFrame:
    """(id, started_at, stopped_at, reason) of each start: the first stop before the next start closes it.

    Marks are few beside the log; the run number is a running count of starts in slices of days, each slice in its own task.
    """
    marks = log.where(F.col("kind").isin("crawler_started", "crawler_stopped")).select("id", "ts", "kind", "reason")
    start = (F.col("kind") == "crawler_started").cast("long")
    slice_ = F.floor(F.col("id") / 4096)
    inside = F.sum(start).over(Window.partitionBy("slice").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    m = marks.withColumn("slice", slice_).withColumn("n", inside)
    per = m.groupBy("slice").agg(F.sum(start).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each slice
    m = m.join(per.select(F.col("slice").alias("sl"), before.alias("b")), F.col("slice") == F.col("sl")).withColumn("run", F.col("n") + F.col("b"))
    stop = F.when(F.col("kind") == "crawler_stopped", F.struct("id", "ts", "reason"))
    first = F.when(F.col("kind") == "crawler_started", F.struct("id", "ts"))
    runs = m.where("run > 0").groupBy("run").agg(F.min(first).alias("a"), F.min(stop).alias("z"))
    return runs.select(F.col("a.id").alias("id"), F.col("a.ts").alias("started_at"), F.col("z.ts").alias("stopped_at"), F.col("z.reason").alias("reason"))


def segments(samples: DataFrame, gap_ms: int = 10_000) -> DataFrame:
    """`samples` with `segment`, from 1 within each run: a new one after each gap of over `gap_ms`."""
    w = Window.partitionBy("run_id").orderBy("id")
    broke = F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap_ms).cast("long"), F.lit(1))
    return samples.withColumn("b", broke).withColumn("segment", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("b")


def merge_ranges(df: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """(key, start, end): each key's ranges with overlapping and touching ones merged."""
    w = Window.partitionBy(key).orderBy("start", "end")
    r = df.select(F.col(key), F.col(start).alias("start"), end.alias("end")).where("start is not null and end >= start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    r = r.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def duplicates(pages: DataFrame) -> DataFrame:
    """(id, first_id): pages whose content an earlier page of the domain with another url already had.

    The earliest page of each content is an aggregate, joined back: no task holds a content that half the pages share.
    """
    p = pages.where("content_hash is not null and domain_id is not null")
    first = p.groupBy(F.col("domain_id").alias("d"), F.col("content_hash").alias("h")).agg(F.min(F.struct("id", "url")).alias("f"))
    both = p.join(first, (F.col("domain_id") == F.col("d")) & (F.col("content_hash") == F.col("h")))
    return both.where("id > f.id and url <> f.url").select("id", F.col("f.id").alias("first_id"))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of equal keys the first in order, as an aggregate."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def next_start(runs: DataFrame, t: int) -> DataFrame:
    """One row, `t`: where a replay goes on after idle time; null after the last run."""
    return runs.where(F.col("started_at") > t).agg(F.min("started_at").alias("t"))

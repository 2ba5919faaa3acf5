"""Grouped aggregates; all combine partially before their shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_weights(sightings: DataFrame) -> DataFrame:
    """(src_domain_id, dst_domain_id, weight, first_seen) of links between different domains."""
    return sightings.where("src <> dst").groupBy(F.col("src").alias("src_domain_id"), F.col("dst").alias("dst_domain_id")).agg(F.count("*").alias("weight"), F.min("seen_at").alias("first_seen"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, n): links in and out of each domain. One pass: each edge counts for both its ends."""
    return edges.select(F.explode(F.array("src_domain_id", "dst_domain_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns: list[str], cap: int = 40) -> DataFrame:
    """(facet, value, n): the most frequent values of each column, nulls aside, by count, then value. One pass over the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select("f.facet", "f.value").where("value is not null")
    n = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("k") <= cap).drop("k")


def downsample(samples: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """The last sample of each bucket of `step` milliseconds from the epoch, within [start, end]."""
    inside = samples.where(F.col("ts").between(start, end))
    last = F.max_by(F.struct(*samples.columns), F.col("id"))
    return inside.groupBy(F.floor(F.col("ts") / step).alias("bucket")).agg(last.alias("s")).select("s.*")


def percentile_threshold(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row, `threshold`: the value at rank ceil(n * share) from the top, at least the first; no row without values.

    Values are counted first, so the ranks run over different values; the running count is over a few rows of each
    quantile slice, not over all in one task.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    at = F.percentile_approx("v", [k / 256 for k in range(1, 256)], 5000)
    edges = v.agg(at.alias("cuts"), F.sum("n").alias("total"))
    sliced = v.crossJoin(F.broadcast(edges)).withColumn("slice", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    per = sliced.groupBy("slice").agg(F.sum("n").alias("m"))
    above = per.withColumn("above", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("slice", "above")
    run = F.sum("n").over(Window.partitionBy("slice").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = sliced.join(above, "slice").withColumn("upto", run + F.col("above"))
    rank = F.greatest(F.ceil(F.col("total") * F.lit(float(share))), F.lit(1))
    return ranked.where(F.col("upto") >= F.least(rank, F.col("total"))).agg(F.max("v").alias("threshold")).where("threshold is not null")


def rolling_sum(df: DataFrame, value: str, since: int) -> DataFrame:
    """One row, `total`, of rows from `since` on; 0 for none."""
    return df.where(F.col("ts") >= since).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def interval_years(ranges: DataFrame, key: str, now: int) -> DataFrame:
    """(key, years): years covered by any of each key's [start, end] ranges, overlaps counted once."""
    from heronry.operators.sequences import merge_ranges

    merged = merge_ranges(ranges, key, "start", F.coalesce(F.col("end"), F.lit(now)))
    return merged.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("years"))


def hit_rate(hits: Column, calls: Column) -> Column:
    """Percentage of cached answers; null without any."""
    return F.when(hits + calls > 0, 100.0 * hits / (hits + calls))


def counts(**tables: DataFrame) -> DataFrame:
    """One row with a column of the rows of each table. The crossed sides are single rows."""
    return reduce(lambda a, b: a.crossJoin(b), [df.agg(F.count("*").alias(name)) for name, df in tables.items()])

"""Problem 4: the N highest-scoring rows of every group, exact, whatever the size of a group.

A histogram of the scores of each group gives a lower threshold above which at least N rows lie; rows below it
are dropped before any ranking, and the few that remain are ranked exactly with the tie keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.session import table

#: Bins of a group's histogram. More bins cut closer and make the histogram larger: at most this many rows a group.
BINS = 256


def top_n(df: DataFrame, group: str, score: str, ties: list[Column], n: int, bins: int = BINS) -> DataFrame:
    """The `n` rows of each `group` with the highest `score`, then by `ties`; the columns of `df` and `rank` (1..n).

    A null or NaN score isn't ranked, a null group is a group of its own. Groups of fewer rows give what they have.
    Repeated rows are rows of their own; make them distinct before, or give ties that end in a unique key.
    The ranges and histograms are combined before the shuffle, so a group that holds most rows makes no large task, and the
    final window sees few rows a group: its limit is also applied before the shuffle, so equal scores in one bin do no harm.
    """
    g, s = "__group", "__score"
    rows = df.withColumn(g, F.col(group)).withColumn(s, F.col(score).cast("double")).where(F.col(s).isNotNull() & ~F.isnan(s))
    span = rows.groupBy(g).agg(F.min(s).alias("__lo"), F.max(s).alias("__hi"))
    # a bin is a monotone function of the score, so a bin's rows all score at least as high as those of a lower bin
    width = F.col("__hi") - F.col("__lo")
    at = F.when(width > 0, F.least(F.floor((F.col(s) - F.col("__lo")) / width * F.lit(bins)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = _with(rows, span, g).withColumn("__bin", at)
    counts = binned.groupBy(g, "__bin").agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.partitionBy(g).orderBy(F.desc("__bin")))
    floor = (
        counts.withColumn("__above", above)
        .groupBy(g)
        # the highest bin with n rows in it and above; where a group has fewer, its lowest bin
        .agg(F.coalesce(F.max(F.when(F.col("__above") >= n, F.col("__bin"))), F.min("__bin")).alias("__floor"))
    )
    kept = _with(binned, floor, g).where(F.col("__bin") >= F.col("__floor"))
    rank = F.row_number().over(Window.partitionBy(g).orderBy(F.desc(s), *ties))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select(*[c for c in df.columns if c != "rank"], "rank")


def _with(rows: DataFrame, per_group: DataFrame, g: str) -> DataFrame:
    """One row a group beside each row, null groups too; AQE picks a broadcast only at a size below the session's bound."""
    right = per_group.withColumnRenamed(g, "__g2")
    return rows.join(right, F.col(g).eqNullSafe(F.col("__g2"))).drop("__g2")


def latest(matches: DataFrame) -> DataFrame:
    """One row a pair: that of the latest computed_at; at one time the higher score, a null score lowest, null times first."""
    newest = F.max(F.struct(F.col("computed_at").cast("long").alias("t"), F.col("score").cast("double").alias("s")))
    return matches.groupBy("profile_id", "job_id").agg(newest.alias("m")).select("profile_id", "job_id", F.col("m.s").alias("score"))


def best_postings(matches: DataFrame, jobs: DataFrame, n: int = 5) -> DataFrame:
    """(profile_id, job_id, score, rank): each profile's `n` best open postings, by score descending, then job_id ascending.

    Of the rows of one pair the latest counts, so rows delivered twice count once; if that row has no score the pair isn't ranked.
    Postings that are closed or not in `jobs` don't count, nor do null ids. Empty tables give no rows. Other columns are ignored.
    """
    pairs = latest(matches.select("profile_id", "job_id", "score", "computed_at").where("profile_id is not null and job_id is not null"))
    pairs = pairs.where("score is not null and not isnan(score)")
    open_ids = jobs.where("closed_at is null and id is not null").select(F.col("id").alias("job_id")).distinct()
    return top_n(pairs.join(open_ids, "job_id", "left_semi"), "profile_id", "score", [F.asc("job_id")], n).select("profile_id", "job_id", "score", "rank")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_postings(table(spark, sf_dir, "job_matches"), table(spark, sf_dir, "jobs"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("profile_id", "job_id")


_RANKED = """
WITH m AS (SELECT profile_id, job_id, score, row_number() OVER (PARTITION BY profile_id, job_id ORDER BY computed_at DESC NULLS LAST, score DESC NULLS LAST) AS k
  FROM job_matches WHERE profile_id IS NOT NULL AND job_id IS NOT NULL),
r AS (SELECT profile_id, job_id, score, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
  FROM m WHERE k = 1 AND score IS NOT NULL AND job_id IN (SELECT id FROM jobs WHERE closed_at IS NULL))
SELECT profile_id, job_id, score, rank FROM r WHERE rank <= 5"""

QUERIES = {"p4_found": found, "p4_ranked": ranked}
SQL = {"p4_found": f"SELECT profile_id, job_id FROM ({_RANKED})", "p4_ranked": _RANKED}

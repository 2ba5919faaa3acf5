"""Problem 2: one ranking from several differently-scaled scores, by median rank aggregation.

Every row's rank on each score is computed, and rows are ordered by the weighted median of their ranks, then by the
mean rank, then by identifier. Only standing counts, so no score rules by its range.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from heronry.session import table

#: Rows of a group that one task ranks at once, about, or a PIECES-th of all rows; larger groups are cut at quantiles of the value.
SLICE, PIECES = 20_000, 2000


@dataclass(frozen=True)
class Score:
    name: str
    ascending: bool = False  # True: smaller is better
    weight: float = 1.0


def _sliced(df: DataFrame, group: str, long: DataFrame, per_slice: int) -> DataFrame:
    """`long` (__g, __k, __v and more) with __s, the slice of its group and score that a row is in, __tie, whether all of the slice have one value, and __before, the rows in better slices.

    Only groups of over `per_slice` rows, and over a PIECES-th of all, have more than one slice; there are fewer than PIECES such groups, and not many more slices, whatever the data. Values
    that fill slices of their own, and nulls, have one that needs no ranking and may be spread over tasks. Cuts only place the borders, so ranks are exact.
    """
    sizes = df.groupBy(F.col(group).alias("b")).agg(F.count("*").alias("n"))
    limit = max(per_slice, (sizes.agg(F.sum("n")).first()[0] or 0) // PIECES)
    big = sizes.where(F.col("n") > limit).collect()
    if not big:
        return long.withColumn("__s", F.lit(0)).withColumn("__tie", F.lit(False)).withColumn("__before", F.lit(0).cast("long"))
    spark = df.sparkSession
    schema = StructType([StructField("b", df.schema[group].dataType), StructField("n", LongType())])
    large = long.join(F.broadcast(spark.createDataFrame(big, schema)), F.col("__g").eqNullSafe(F.col("b")))
    at = F.percentile_approx("__v", [k / 500 for k in range(1, 500)], 5000)
    known = []
    for r in large.groupBy("b", F.col("__k").alias("c")).agg(at.alias("all"), F.first("n").alias("n")).where("all is not null").collect():
        thin = r["all"][:: max(1, int(500 * limit / r.n))]
        known.append((r.b, r.c, sorted(set(thin)), sorted({x for x, y in zip(thin, thin[1:]) if x == y})))
    cuts = StructType([schema["b"], StructField("c", IntegerType()), StructField("cuts", ArrayType(DoubleType())), StructField("ties", ArrayType(DoubleType()))])
    known = F.broadcast(spark.createDataFrame(known, cuts))
    v = F.col("__v")
    tie = F.coalesce(v.isNull() | F.array_contains("ties", v), F.lit(False))
    slice_ = F.when(F.col("cuts").isNull(), 0).when(v.isNull(), -1).otherwise(2 * F.size(F.filter("cuts", lambda c: c < v)) + F.when(F.array_contains("ties", v), 1).otherwise(0))
    met = long.join(known, F.col("__g").eqNullSafe(F.col("b")) & (F.col("__k") == F.col("c")), "left")
    met = met.withColumn("__s", slice_.cast("int")).withColumn("__tie", F.col("cuts").isNotNull() & tie)
    per = met.where("cuts is not null").groupBy("b", "c", F.col("__s").alias("s")).agg(F.count("*").alias("m"))
    above = Window.partitionBy("b", "c").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("b", "c", "s", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("__before"))
    before = F.broadcast(spark.createDataFrame(before.collect(), before.schema))
    out = met.drop("b", "c", "cuts", "ties").join(before, F.col("__g").eqNullSafe(F.col("b")) & (F.col("__k") == F.col("c")) & (F.col("__s") == F.col("s")), "left")
    return out.withColumn("__before", F.coalesce("__before", F.lit(0))).drop("b", "c", "s")


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """Of the ranks that aren't null: that at which half of their weight is passed; where it's just reached, the middle of that and the next."""
    pairs = F.array_sort(F.filter(F.array(*[F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]), lambda p: p["r"].isNotNull()))
    half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"]) / 2
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a: Column, p: Column) -> Column:
        w = a["w"] + p["w"]
        take = lambda old, reached: F.when(old.isNull() & reached, p["r"]).otherwise(old)
        return F.struct(w.alias("w"), take(a["lo"], w >= half).alias("lo"), take(a["hi"], w > half).alias("hi"))

    return F.aggregate(pairs, start, step, lambda a: (a["lo"] + a["hi"]) / 2)


def fuse(df: DataFrame, group: str, item: str, scores: list[Score], per_slice: int = SLICE) -> DataFrame:
    """(group, item, rank_<score>..., median_rank, mean_rank): one row for each item of each group.

    Of repeated rows of an item the best value of each score counts. A score that no row of the group has isn't recorded there and
    has no say; an item without a value of a recorded score stands behind all that have one. Where nothing is recorded
    the medians are null and the identifier decides. Null groups and items form rows of their own; NaN counts as null. Other columns are ignored.
    """
    best = [(F.min if s.ascending else F.max)(F.when(~F.isnan(F.col(s.name).cast("double")), F.col(s.name).cast("double"))).alias(f"__v{k}") for k, s in enumerate(scores)]
    # an item's repeated rows are combined before the shuffle; then all scores are ranked in one shuffle, larger values being better, and brought together by item in another
    rows = df.groupBy(F.col(group).alias("__g"), F.col(item).alias("__i")).agg(*best)
    each = F.array(*[F.struct(F.lit(k).alias("k"), (-F.col(f"__v{k}") if s.ascending else F.col(f"__v{k}")).alias("v")) for k, s in enumerate(scores)])
    long = rows.select("__g", "__i", F.explode(each).alias("x")).select("__g", "__i", F.col("x.k").alias("__k"), F.col("x.v").alias("__v"))
    placed = _sliced(df, group, long, per_slice)
    # nulls rank behind all values; a null that comes first has no value before it: the score isn't recorded in the group
    spread = F.when(F.col("__tie"), F.pmod(F.xxhash64("__i"), F.lit(PIECES))).otherwise(0)
    within = F.rank().over(Window.partitionBy("__g", "__k", "__s", spread).orderBy(F.desc_nulls_last("__v")))
    ranked = placed.withColumn("__r", F.col("__before") + F.when(F.col("__tie"), 1).otherwise(within))
    ranked = ranked.withColumn("__r", F.when(F.col("__v").isNotNull() | (F.col("__r") > 1), F.col("__r")))
    rows = ranked.groupBy("__g", "__i").agg(*[F.max(F.when(F.col("__k") == k, F.col("__r"))).alias(f"__r{k}") for k in range(len(scores))])
    full = [F.col(f"__r{k}") for k in range(len(scores))]
    weights = [s.weight for s in scores]
    total = reduce(lambda a, b: a + b, [F.when(r.isNotNull(), F.lit(float(w))).otherwise(0.0) for r, w in zip(full, weights)])
    mean = reduce(lambda a, b: a + b, [F.coalesce(r * F.lit(float(w)), F.lit(0.0)) for r, w in zip(full, weights)]) / F.nullif(total, F.lit(0.0))
    return rows.select(F.col("__g").alias(group), F.col("__i").alias(item), *[r.cast("long").alias(f"rank_{s.name}") for r, s in zip(full, scores)], weighted_median(full, weights).alias("median_rank"), F.round(mean, 9).alias("mean_rank"))


#: The scores of a search's hits: each has an equal say.
HIT_SCORES = [Score("match_score"), Score("relevance", ascending=True), Score("salary_usd_annual")]
_NAMES = [s.name for s in HIT_SCORES]


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "search_hits"), "search_id", "job_id", HIT_SCORES)


def first(fused: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, item): each group's first item, by median rank, then mean rank, then identifier (nulls last). A minimum, so it's combined before the shuffle."""
    last = F.lit(float("inf"))
    order = F.struct(F.coalesce("median_rank", last), F.coalesce("mean_rank", last), F.col(item).isNull(), F.col(item))
    return fused.groupBy(group).agg(F.min_by(F.struct(F.col(item)), order).alias("m")).select(group, F.col(f"m.{item}").alias(item))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(ranking(spark, sf_dir), "search_id", "job_id", _NAMES)


_RANK = """
WITH h AS (SELECT search_id, job_id, max(match_score) AS a, min(relevance) AS b, max(salary_usd_annual) AS c FROM search_hits GROUP BY search_id, job_id),
n AS (SELECT search_id, count(a) AS na, count(b) AS nb, count(c) AS nc FROM h GROUP BY search_id),
r AS (SELECT h.search_id, job_id,
  CASE WHEN na > 0 THEN CASE WHEN a IS NULL THEN na + 1 ELSE rank() OVER (PARTITION BY h.search_id ORDER BY a DESC NULLS LAST) END END AS ra,
  CASE WHEN nb > 0 THEN CASE WHEN b IS NULL THEN nb + 1 ELSE rank() OVER (PARTITION BY h.search_id ORDER BY b NULLS LAST) END END AS rb,
  CASE WHEN nc > 0 THEN CASE WHEN c IS NULL THEN nc + 1 ELSE rank() OVER (PARTITION BY h.search_id ORDER BY c DESC NULLS LAST) END END AS rc
  FROM h JOIN n USING (search_id)),
f AS (SELECT *, list_sort(list_filter([ra, rb, rc], lambda x: x IS NOT NULL)) AS l FROM r),
z AS (SELECT search_id, job_id, CAST(ra AS BIGINT) AS rank_match_score, CAST(rb AS BIGINT) AS rank_relevance, CAST(rc AS BIGINT) AS rank_salary_usd_annual,
  (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0 AS median_rank, round(list_sum(l) / CAST(len(l) AS DOUBLE), 9) AS mean_rank FROM f)
"""
SQL = {
    "p2_found": _RANK + "SELECT search_id, job_id FROM z QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY median_rank, mean_rank, job_id) = 1",
    "p2_ranking": _RANK + "SELECT * FROM z",
}
QUERIES = {"p2_found": found, "p2_ranking": ranking}

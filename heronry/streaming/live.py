"""The live parts as Structured Streaming: tails, rates with carried state, buckets with late data, domain state and caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators.merge import latest_per_key
from heronry.session import checkpoint_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, folder: str, schema: str = EVENTS, after: int = -1, files: int = 16) -> DataFrame:
    """Events appended to a folder after an id. `files` bounds a micro-batch, so a backlog is worked off in pieces."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).where(F.col("event_id") > after)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to the end, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [x.getPath() for x in (fs.listStatus(root) if fs.exists(root) else [])]
    return sorted(int(x.getName().split("=")[1]) for x in there if x.getName().startswith("batch=") and fs.exists(hadoop.Path(x, "_SUCCESS")))


def last_batch(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest batch in a folder, or the newest before a number; None without one."""
    there = [n for n in _batches(spark, folder) if before is None or n < before]
    return spark.read.parquet(f"{folder}/batch={there[-1]}") if there else None


def run_once(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, keys: list[str] | None = None, whole: bool = False) -> DataFrame | None:
    """Works off what there is and stops. The result lies in files of the checkpoint folder, a folder a batch, so that a repeated batch changes nothing and none of it is in the driver.

    Rows of all batches; with `keys` the newest of each key, of a stream of updates; with `whole` the newest batch, of a stream that gives its whole result each time; with `each` what that does with every batch.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{name}"
    write = each or (lambda batch, n: batch.withColumn("__n", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
    mode = "update" if keys else "complete" if whole else "append"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if each:
        return None
    there = _batches(spark, f"{root}/out")
    if not there:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(*[f"{root}/out/batch={n}" for n in (there[-1:] if whole else there)])
    if keys:
        rows = latest_per_key(rows, keys, [F.col("__n")])
    return rows.select(*stream.columns)


def lagged(sent: int, seen: int, limit: int) -> dict | None:
    """What a slow reader is told when more events wait than it is sent: how many it skips."""
    behind = seen - sent
    return {"type": "lagged", "skipped": behind - limit} if behind > limit else None


def bucket_activity(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) of tumbling windows; events later than `late` are past their window."""
    t = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): activity of a user without a gap."""
    t = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return t.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that writes (event_id, user_id, rate): each run's counter a second since its sample before, over the borders of batches.

    One row a run, its last, is carried from batch to batch in files. Rows of ids at or before it are repeats and dropped. Differences are windows in the JVM, which spill.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.lit(True).alias("new")).dropDuplicates(["user_id", "event_id"])
        carry = last_batch(batch.sparkSession, f"{target}/carry", number)
        if carry is not None:
            last = carry.select("user_id", F.col("event_id").alias("__last"))
            rows = rows.join(last, "user_id", "left").where("__last is null or event_id > __last").drop("__last").unionByName(carry.withColumn("new", F.lit(False)))
        w = Window.partitionBy("user_id").orderBy("event_id")
        secs = (F.col("ms") - F.lag("ms").over(w)) / 1000.0
        rates = rows.withColumn("secs", secs).where("new and secs > 0").select("event_id", "user_id", (F.greatest("value", F.lit(0.0)) / F.col("secs")).alias("rate"))
        rates.write.mode("overwrite").parquet(f"{target}/rates/batch={number}")
        latest_per_key(rows.drop("new"), ["user_id"], [F.col("event_id")]).write.mode("overwrite").parquet(f"{target}/carry/batch={number}")

    return each


def carried_rates(stream: DataFrame, name: str) -> DataFrame:
    """(event_id, user_id, rate) of a stream of events, by `rates_batch`."""
    spark = stream.sparkSession
    target = f"{checkpoint_dir(spark)}/rates-{name}"
    run_once(stream, name, rates_batch(target))
    there = _batches(spark, f"{target}/rates")
    schema = "event_id long, user_id long, rate double"
    return spark.read.schema(schema).parquet(*[f"{target}/rates/batch={n}" for n in there]) if there else spark.createDataFrame([], schema)


def latest_status(stream: DataFrame) -> DataFrame:
    """(user_id, event_type): the last event of each, as a running aggregate."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


def merge_batch(target: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that keeps the latest row of each key in a folder: the snapshot is written beside it and named by the batch, so a repeated batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        before = last_batch(batch.sparkSession, target, number)
        rows = batch if before is None else before.unionByName(batch)
        latest_per_key(rows, keys, [F.col(order)]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each

"""Streaming operators over the event table (inventory K): each runs its stream until all files are worked off."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators import timeline
from heronry.operators.sequences import segments
from heronry.plans.model import Model, registry
from heronry.streaming import live

QUERIES, SQL, query = registry()


def _stream(m: Model, after: int = -1) -> DataFrame:
    """The event table as a stream. A file source reads folders or patterns, so a single file is named by a pattern."""
    path = f"{m.dir}/events.parquet"
    if os.path.isfile(path):
        path = f"{m.dir}/events.parqu*t"
    return live.tail(m.spark, path, after=after)


def _fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("K1_tail", "SELECT event_id, event_type FROM events WHERE event_id > 100")
def _(m: Model) -> DataFrame:
    return live.run_once(_stream(m, 100).select("event_id", "event_type"), _fresh("tail"))


@query("K2_carried_rates", "SELECT event_id, user_id, round(greatest(value, 0) / (dt / 1000.0::DOUBLE), 9) AS rate FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM events) WHERE dt > 0")
def _(m: Model) -> DataFrame:
    return live.carried_rates(_stream(m), _fresh("rates")).select("event_id", "user_id", F.round("rate", 9).alias("rate"))


@query("K4_buckets", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    # updates also tell of the windows that the watermark hasn't passed at the end
    b = live.run_once(live.bucket_activity(_stream(m)), _fresh("buckets"), keys=["start", "event_type"])
    return b.select(F.unix_millis("start").alias("t"), "event_type", "n")


@query("K5_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS t, count(*) AS n FROM s GROUP BY user_id, k")
def _(m: Model) -> DataFrame:
    # session windows give no updates; the whole result also has the sessions that are still open at the end
    return live.run_once(live.sessions(_stream(m)), _fresh("sessions"), whole=True).select("user_id", F.unix_millis("start").alias("t"), "n")


@query("K6_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(m: Model) -> DataFrame:
    return live.run_once(live.latest_status(_stream(m)), _fresh("status"), keys=["user_id"])


@query("K8_by_id", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(m: Model) -> DataFrame:
    return m.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("K10_data_cap", "SELECT run_id, min(id) AS stop_id FROM samples WHERE bytes >= 50000 GROUP BY run_id", "samples")
def _(m: Model) -> DataFrame:
    return timeline.stop_at_bytes(m.samples, 50_000)


@query("K11_sliding_sum", "SELECT id, CAST(sum(new) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_sum FROM log", "log")
def _(m: Model) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("ts").rangeBetween(-86_400_000, 0)
    return m.log.select("id", F.sum("new").over(w).alias("day_sum"))


@query("K5_gap_runs", "SELECT run_id, max(segment) AS parts FROM (SELECT run_id, 1 + count(*) FILTER (g > 21600000) OVER (PARTITION BY run_id ORDER BY id) AS segment FROM (SELECT id, run_id, ts - lag(ts) OVER (PARTITION BY run_id ORDER BY id) AS g FROM samples)) GROUP BY run_id", "samples")
def _(m: Model) -> DataFrame:
    return segments(m.samples, 21_600_000).groupBy("run_id").agg(F.max("segment").alias("parts"))

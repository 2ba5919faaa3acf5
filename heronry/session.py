"""Session settings and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "heronry", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE with skew handling, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once a context, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_heronry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it runs from such a file already
        to = Path(tempfile.mkdtemp()) / "heronry_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(to))
    sc._heronry_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """`df`, for whose Python functions this package is there."""
    ship(df.sparkSession)
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only where that is unset and the session is local (tests) a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or os.path.join(tempfile.gettempdir(), f"heronry-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from there: the lineage ends, lost executors cost nothing."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, factor: int = 3) -> DataFrame:
    """Hash-repartition by `key` only where the scan has fewer splits than would keep the cores busy with Python work.

    Splits of fewer files than cores may have nothing to read, as a row group isn't split: these must be twice the cores.
    """
    ship(df.sparkSession)
    par = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    busy = splits >= 2 * par or (splits >= par and len(df._jdf.inputFiles()) >= par)
    return df if busy else df.repartition(factor * par, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

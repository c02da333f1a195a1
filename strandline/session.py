"""Session construction and the few settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of a stand-alone run. A cluster's own settings win: ``spark_session``
#: only applies them to a session that it creates itself.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def spark_session(cpus: int | str = "*", app: str = "strandline", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the given one."""
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or n)).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only a session without ``spark.checkpoint.dir`` (tests, one machine) gets a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_strandline_dir", None)
    if own is None:
        own = spark._strandline_dir = tempfile.mkdtemp(prefix="strandline-")
    return own


#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` computed once, its lineage cut through the shared folder.

    A reliable checkpoint: what an executor wrote outlives it. With ``clean`` the shuffle
    files behind it are removed at once, not when the driver collects its garbage; then
    ``df`` itself is not to be computed again.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    if not clean:
        return df.checkpoint(eager=True)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # of a frame of its own: the setting is read when a frame is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, was)

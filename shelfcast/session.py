"""SparkSession helpers: sane defaults for local runs, cluster settings respected."""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfcast") -> SparkSession:
    """Return the active session or build one with local-friendly defaults.

    On a cluster the active session (and its ``spark.checkpoint.dir``) wins: nothing here
    overrides settings that are already present.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its
    own and any other is refused: its executors would not see a folder of the driver's machine."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is at ``path``, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def spread(df, *keys: str):
    """``df`` dealt by ``keys`` over all shuffle partitions. A few small rows that much work follows from would
    otherwise be coalesced into one task by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df):
    """Cut lineage of a reused intermediate with a reliable checkpoint in the shared
    ``spark.checkpoint.dir`` (survives executor loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    from pyspark import StorageLevel
    # Persist first so the eager checkpoint computes the plan once (count + file write), then
    # drop the cache: later reads come from the checkpoint files.
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)


def side_by_side(spark: SparkSession, jobs: list, width: int = 4) -> list:
    """Results of ``jobs`` (callables without arguments that run Spark jobs), at most ``width`` at a time, in order.

    Each runs in a scheduler pool of its own, so with the fair scheduler a long fit does not hold up the others. The
    first error is raised when all that run have ended."""
    def pooled(k, job):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{k % width}")
            return job()
        return inheritable_thread_target(spark)(run)
    with ThreadPoolExecutor(max(1, min(width, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(pooled(k, job)) for k, job in enumerate(jobs)]]

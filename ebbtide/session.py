"""SparkSession construction with settings that hold from local[8] up to a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "ebbtide",
              shuffle_partitions: int | None = None, local_memory: str = "8g") -> SparkSession:
    """Build (or reuse) a session.

    ``master`` is only set when given: on a cluster the launcher decides it
    (and the executor / driver sizes). On a local master the driver JVM is
    also the only executor, so it gets ``local_memory`` of heap instead of
    the 1 GB default (applies when this call starts the JVM).
    Shuffle partitions default to Spark's own value unless given; AQE then
    coalesces small partitions and splits skewed ones at runtime.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local") and local_memory:
            b = b.config("spark.driver.memory", local_memory)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone
    (and must be set). Only when it is unset on a local master (tests) do we
    pick a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is not visible to the other executors
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
        d = tempfile.mkdtemp(prefix="ebbtide-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)  # our own folder, local masters only
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[str] = []


@atexit.register
def _remove_scratch() -> None:
    """At the end of the driver's process its intermediate tables go, if the session
    still runs (a session that was stopped before leaves them to the folder's owner)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    for folder in _SCRATCH:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for intermediate tables; removed
    when the driver's process ends."""
    base = ensure_checkpoint_dir(spark)
    folder = os.path.join(base, name)
    _SCRATCH.append(folder)
    return folder

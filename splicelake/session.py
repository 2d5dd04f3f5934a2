"""Session helpers shared by operators and tests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "splicelake", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # checkpoints go when their frames do
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def _checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints, set where it isn't yet.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where neither
    that nor a directory set by the caller exists, and driver and executors are one
    process (as in tests), is a temporary folder used."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="splicelake-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for files that a job writes and reads again."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    Only for stages that are heavy per row (Python). A large input already has
    many splits and passes unchanged, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df

"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every claimscope job relies on. AQE re-plans joins at runtime
# (size-checked broadcast, skew splitting) and coalesces small shuffle
# partitions; decimals keep money exact; Parquet output is ZSTD.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.ansi.enabled": "true",
    # each dashboard checkpoints its (small) grouping-set aggregate; delete
    # those files once the checkpointed data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Sizing for a large cluster (on the order of 1000 executors, 100 TB of
# Parquet): ~256 MB scan splits, an initial shuffle width that AQE coalesces
# down to ~256 MB partitions, skew splitting above 512 MB, runtime broadcast
# only below 64 MB, and executor decommissioning that migrates shuffle
# blocks so a lost executor costs as little recomputation as possible.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.task.maxFailures": "8",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "claimscope", extra: dict | None = None,
              profile: str = "local") -> SparkSession:
    """Return (or create) a session with claimscope's defaults.

    ``master`` and ``shuffle_partitions`` are only applied when given, so on a
    cluster the launcher's settings win. ``profile="cluster"`` adds
    :data:`CLUSTER_CONF`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("CLAIMSCOPE_DRIVER_MEM", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage and to stage written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    go without: it gets a fresh scratch folder. On a cluster a folder of one
    machine would be invisible to the others, so an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share "
                             f"(master {sc.master})")
        configured = tempfile.mkdtemp(prefix="claimscope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")

"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE coalesces the small
# post-shuffle partitions of the per-message / per-document aggregates and
# splits skewed join partitions at run time.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # The per-message / per-document stages after the order-keyed shuffle
    # are CPU bound (parsing, rule expressions): byte-sized coalescing merges
    # their partitions into fewer, uneven tasks (measured: 11.6 s -> 7.7 s
    # for json_doc_summary at sf0.1 without it).  The shuffle partition count
    # is the parallelism knob; set it for the cluster.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Broadcast only what is known to be small: the rule, mapping, code and
    # statement tables carry an explicit hint after a size check.  Every other
    # join side grows with the data, so no size-estimate-driven broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    # target size for skew splitting
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "recordchecks", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if driver_memory:  # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` names it.  Where it is unset, only a session whose
    executors live in the driver's process (local mode, as in tests) gets a
    folder of its own; on a cluster a machine-local folder would lose what
    other executors write, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="recordchecks-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/recordchecks/{name}-{uuid.uuid4().hex}"

"""Session factory and the shared scratch/checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes
# (a broadcast only happens after the build side was measured), splits skewed
# shuffle partitions, and coalesces small ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "dialectic",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster submit keeps its own values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be given (a shared file system path that
    survives executor loss). Only a local session without it gets a fresh
    folder of its own, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) before running iterative operators"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dialectic-ckpt-"))
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# Target bytes per partition for explicit repartitions (AQE sizes the rest).
TARGET_PARTITION_BYTES = 256 << 20
MAX_PARTITIONS = 1 << 16
UNKNOWN_SIZE_BYTES = 1 << 52


def partitions_for(df, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for an explicit ``repartition`` of ``df``: at least
    ``spark.sql.shuffle.partitions``, and enough that each partition holds
    about ``target_bytes`` by Catalyst's size estimate of the plan."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # estimate unavailable (e.g. remote session)
        return n
    # Plans Catalyst cannot size report spark.sql.defaultSizeInBytes
    # (Long.MaxValue), possibly scaled by projections: treat anything above
    # a few petabytes as "no estimate" and keep the configured count.
    if size >= UNKNOWN_SIZE_BYTES:
        return n
    return int(min(MAX_PARTITIONS, max(n, -(-size // target_bytes))))

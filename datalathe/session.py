"""Session helpers: a configured local session for tests and benches, and
checkpoint-folder discovery that respects the cluster's own setting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "datalathe",
              driver_memory: str = "16g") -> SparkSession:
    """Local session used by tests and ``bench.py``. On a cluster, build the
    session with the cluster's own settings instead; operators never depend
    on anything set here."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session. Only when it is unset *and* Spark runs in local mode
    (tests, benches) do we pick a fresh folder ourselves; on a cluster an
    unset folder is an error, never a machine-local temporary path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if sc.master == "local" or sc.master.startswith("local["):
        base = os.environ.get("TMPDIR", "/tmp")
        folder = tempfile.mkdtemp(prefix="datalathe-ckpt-", dir=base)
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder (HDFS/S3/ABFS) for checkpoints")

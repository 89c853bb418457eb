"""Session defaults and the shared working folder.

Library code never invents a machine-local scratch folder: anything that must
survive executor loss (checkpoints, result caches, exports without an explicit
target) goes below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                checkpoint_dir: str | None = None, app_name: str = "tablekit",
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults this library assumes.

    ``checkpoint_dir`` is only applied when the cluster has not named one.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if checkpoint_dir and not shared_root(spark, required=False):
        set_shared_root(spark, checkpoint_dir)
    return spark


def shared_root(spark: SparkSession, required: bool = True) -> str | None:
    """The cluster-wide folder from ``spark.checkpoint.dir`` (or the context's)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and required:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(e.g. an object-store or HDFS path) before using checkpoints or caches")
    return root or None


def set_shared_root(spark: SparkSession, path: str) -> None:
    """Name a shared folder where none is configured (tests, local runs)."""
    spark.sparkContext.setCheckpointDir(path)


def shared_path(spark: SparkSession, *parts: str) -> str:
    root = shared_root(spark).rstrip("/")
    return "/".join([root, *parts]) if "://" in root else os.path.join(root, *parts)

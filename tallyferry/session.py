"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is written for; every one can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Many-to-one relation joins on a hot foreign key are split at run time.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors can reach, under the cluster's `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/tallyferry/{purpose}-{uuid.uuid4().hex}"


def keep(df: DataFrame, purpose: str = "kept") -> DataFrame:
    """Write rows once to the shared scratch folder and read them back.

    Later passes read only the columns they need, and a lost executor costs no recomputation. The files
    are in the scratch folder of the cluster, which owns their removal.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

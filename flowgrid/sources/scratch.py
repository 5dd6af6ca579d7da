"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only where that is unset and the master is this machine, as in
    tests, a temporary folder is made, once a session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("flowgrid.scratch.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="flowgrid-")
        spark.conf.set("flowgrid.scratch.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/flowgrid/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: computed once, kept in the shared folder, same rows from now on."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)

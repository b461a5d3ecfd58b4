"""Cutting long lineage through reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what the cluster names in
    ``spark.checkpoint.dir``. Only a session inside one process may go without; it takes a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskloom-checkpoint-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Materialise once in the checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet into the shared folder and read it back: lineage ends, columns can be pruned."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

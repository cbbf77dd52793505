"""Work whose result several branches of a plan read, done once."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where that is unset and the master is local, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; a cluster needs a shared folder there")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder: what it was dealt by still holds, rows are written as they are in memory."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: a fraction of a checkpoint's size, but dealt by nothing."""
    path = f"{_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

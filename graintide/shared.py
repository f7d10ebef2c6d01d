"""Work folders that driver and executors share, and tables kept in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(folder, "own", None)
        if base is None:
            base = folder.own = "file://" + tempfile.mkdtemp(prefix="graintide-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors cost no more than a reread."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the operators share: the shared work folder and tables kept in it."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(work_dir, "own", None)
        if base is None:
            base = work_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most so many rows for Python within the block: whole texts fill both sides' buffers.  For what is written within it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_held: tuple[str, object] | None = None


def resident(name: str, make: Callable[[], object]):
    """The worker's one long-lived object (a tokenizer or a memo), made anew when another kind was held.

    Python workers live on from stage to stage, so what one stage remembers is let
    go, and its memory given back, when the next asks for its own.
    """
    global _held
    if _held is None or _held[0] != name:
        if _held is not None:
            _held = None
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
        _held = (name, make())
    return _held[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

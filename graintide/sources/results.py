"""History of results: rows appended to a table, and exports of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(rows: DataFrame, path: str, run: str) -> None:
    """Append one run's rows; the run is a partition, so that the same run written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def results(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """All runs' rows, or one run's."""
    found = spark.read.parquet(path)
    return found if run is None else found.filter(F.col("run") == run)


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header."""
    if kind not in ("json", "csv"):
        raise ValueError(f"no export of kind {kind}")
    if kind == "json":
        rows.write.json(path, ignoreNullFields=False)
    else:
        rows.write.csv(path, header=True, nullValue="")

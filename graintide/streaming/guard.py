"""A guard at the edge of a stream: good rows go on, declined ones are put aside with their reason, and both are counted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.shared import folder, keep


@dataclass
class Sinks:
    """What a guard has written: accepted rows, quarantined rows with status, and counts (status, n) by batch."""

    accepted: DataFrame
    quarantined: DataFrame
    counts: DataFrame


def guarded(spark: SparkSession, stream: DataFrame, judge: Callable[[DataFrame], DataFrame], base: str | None = None) -> Sinks:
    """Run the stream over all that is available and sort its rows by ``status``, which ``judge`` adds: ok or a reason.

    A batch is judged once, as one table in the shared folder.  Each sink has a part a batch id, which a
    batch that runs again replaces, so rows are neither lost nor doubled.  No state is kept: late rows pass like others.
    """
    base = base or folder(spark, "guard")
    schema = judge(spark.createDataFrame([], stream.schema)).schema

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = keep(judge(batch), "judged")
        part = f"batch={batch_id}"
        rows.filter("status = 'ok'").write.mode("overwrite").parquet(f"{base}/accepted/{part}")
        rows.filter("status <> 'ok' OR status IS NULL").write.mode("overwrite").parquet(f"{base}/quarantine/{part}")
        rows.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/counts/{part}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(put).start().awaitTermination()
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{base}/{name}/batch=*")
    return Sinks(read("accepted", schema), read("quarantine", schema), spark.read.schema("status string, n long, batch int").parquet(f"{base}/counts"))

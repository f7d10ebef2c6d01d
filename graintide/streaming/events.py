"""Streaming jobs over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.shared import folder

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def tumbling_volume(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and type; closed windows leave the state once the watermark passes them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def volume_by_parts(spark: SparkSession, stream: DataFrame, width: str = "1 hour", base: str | None = None) -> DataFrame:
    """Events per window and type without a state: each batch adds its own counts as a part, and parts are summed when read.

    A late event adds to its window's count whenever it comes.  A batch that runs again replaces its part; ``merge_parts`` keeps them few.
    """
    base = base or folder(spark, "volume")

    def put(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type").agg(F.count("*").alias("n"))
        counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n").write.mode("overwrite").parquet(f"{base}/parts/batch={batch_id}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(put).start().awaitTermination()
    return summed_parts(spark, base)


_VOLUME = "window_start timestamp_ntz, event_type string, n long, batch int"


def summed_parts(spark: SparkSession, base: str) -> DataFrame:
    """The counts of all parts under base: merged ones, and those of the batches since."""
    parts = spark.read.schema(_VOLUME).parquet(f"{base}/parts")
    merged = f"{base}/merged"
    try:
        done = spark.read.parquet(merged)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return parts.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
    last = done.agg(F.max("upto")).first()[0]
    rest = parts.filter(F.col("batch") > last).select("window_start", "event_type", "n")
    return done.filter(F.col("upto") == last).select("window_start", "event_type", "n").unionByName(rest).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))


def merge_parts(spark: SparkSession, base: str) -> None:
    """One table in place of the parts so far; the newest merge counts, so one that is cut off changes nothing."""
    upto = spark.read.schema(_VOLUME).parquet(f"{base}/parts").agg(F.max("batch")).first()[0]
    if upto is not None:
        summed_parts(spark, base).write.mode("overwrite").parquet(f"{base}/merged/upto={upto}")


def run_available(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available and read its result back; a rerun with the same folder resumes.

    Complete mode overwrites one table with each batch; append mode adds one part per batch id, so that a batch
    that is run again after a failure replaces its own part.
    """
    base = folder(spark, "stream")

    def put(batch: DataFrame, batch_id: int) -> None:
        place = f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(place)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of parts; a stream takes a single file only by a pattern."""
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/event[s].parquet")

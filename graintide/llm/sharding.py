"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair gets a hash u in (0, 1); the record goes to the
shard with the least ``-ln(u) / weight``.  A shard's share is its weight's
share, and when a shard is added a record either stays or moves to the new
shard.  Only built-in functions run; the records themselves shuffle once, as
narrow rows without their text.

Defined cases: a null key hashes as one fixed key; null text has size 1 and
crc32 0; repeated keys go to the same shard and get slots of their own; an empty
table gives an empty result.  Columns of the input other than the key and the
text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide.llm.common import table

NULL_KEY = "\x00null"


def _cost(key: Column, shard: int, weight: float, seed: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", F.lit(seed), key, F.lit(str(shard)))), 11)
    unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """Shard number of a key; ``weights[i]`` is shard i's weight (positive)."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    costs = [F.struct(_cost(text, i, w, seed).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*costs))["shard"]


def number_within(df: DataFrame, group: str, key: str, order: Sequence[str], buckets: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without one task per group.

    Rows of a group are dealt into ``buckets`` parts by their key's hash; each part
    numbers its own rows and adds the count of the parts before it.  The table of
    counts has at most groups x buckets rows, which bounds the broadcast.
    """
    parts = df.withColumn("_part", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = parts.withColumn("_rank", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(starts), [group, "_part"]).withColumn(out, (F.col("_start") + F.col("_rank")).cast("long")).drop("_start", "_rank", "_part")


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, new_weight: float = 1.0, slot_buckets: int = 1024) -> DataFrame:
    """Shard, slot and the shard after one more of ``new_weight`` is added, for every record."""
    body = F.col(text)
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).cast("int").alias("shard"),
        shard_of(F.col(key), [*weights, new_weight]).cast("int").alias("grown_shard"),
    )
    numbered = number_within(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"], slot_buckets, "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))

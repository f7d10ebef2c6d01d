"""Document fingerprints by one-permutation MinHash, in built-in functions.

A text's five-word shingles are hashed once; the hash's top bits name one of 128
bins and each bin keeps its least hash.  An empty bin takes the value of the
first filled bin in its own fixed random order of bins (optimal densification).
Of each bin the low 8 bits are kept, packed as hex.  Two fingerprints agree by
chance in 2^-8 of the bins; the likeness removes that share.

Defined cases: null text counts as empty; texts without words share one fixed
fingerprint; a text of fewer than five words is one shingle; equal texts give
equal fingerprints.  The next document is that of the next doc_id, after the
last the first; null doc_ids come first, repeated ones are taken in order of
their text.  A single row is its own next document.  An empty table gives an
empty result.  Columns other than key and text are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide.llm.common import table

BINS, LOW_BITS, WORDS = 128, 8, 5
#: Rows of a key range, and most ranges at the first level (bounds the broadcast tables).
RANGE_ROWS, MOST_RANGES = 1_000, 100_000
_TO_BIN = 64 - (BINS.bit_length() - 1)


def _orders(seed: int = 9) -> Column:
    """Each bin's order of the bins it may copy from: fixed, random, without repeats."""
    rng = random.Random(seed)
    return F.expr("array(" + ",".join(f"array({','.join(map(str, rng.sample(range(BINS), BINS)))})" for _ in range(BINS)) + ")")


def _bin(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, _TO_BIN).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint as array<tinyint> ``out``: the low bits of each bin, less 128."""
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn("_words", F.transform(tokens, lambda w: F.xxhash64(w)))
    short = F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: F.xxhash64(s, w))
    grams = F.transform(F.sequence(F.lit(0), F.size("_words") - WORDS), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WORDS)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_hashes", F.when(F.size("_words") >= WORDS, F.sort_array(grams)).when(F.size("_words") > 0, F.array(short)).otherwise(none))
    # sorted, the hashes of a bin stand together and its least comes first
    df = df.withColumn("_least", F.filter("_hashes", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_hashes", i - 1)))))
    df = df.withColumn("_filled", F.transform("_least", _bin))
    at = lambda b: F.array_position("_filled", b).cast("int")
    donor = lambda b: F.get(F.array_intersect(F.get(_orders(), b), F.col("_filled")), 0)
    place = lambda b: F.coalesce(F.nullif(at(b), F.lit(0)), at(donor(b))) - 1
    low = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: (F.get("_least", place(b)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - 128).cast("tinyint"))
    df = df.withColumn(out, F.when(F.size("_least") == 0, F.array_repeat(F.lit(0).cast("tinyint"), BINS)).otherwise(low))
    return df.drop("_words", "_hashes", "_least", "_filled")


def packed(bins: Column) -> Column:
    """Hex string of the bins' low bits."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.cast("int") + 128), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: the share of equal bins less that of chance, 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def with_next(df: DataFrame, key: str, order: list[str], carried: list[str]) -> DataFrame:
    """Add next_<column> from the row that follows by key; after the last comes the first.

    The keys' range is cut into equal widths and a width that holds many rows is cut
    again; rows follow each other within a range, and the first rows of each range
    are also laid behind the range before it.  The rows shuffle once.  What is
    broadcast has one row a range: at most MOST_RANGES at the first level.
    """
    df = df.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-(2**62))))
    seen = df.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        return df.drop("_key").withColumns({f"next_{c}": F.col(c) for c in carried})
    ranges = min(MOST_RANGES, max(1, seen["n"] // RANGE_ROWS))
    width = (seen["hi"] - seen["lo"] + 1) / ranges
    wide = F.floor((F.col("_key").cast("double") - F.lit(float(seen["lo"]))) / F.lit(width)).cast("int")
    df = df.withColumn("_wide", wide)
    limit = 4 * max(RANGE_ROWS, seen["n"] // ranges)
    cuts = df.groupBy("_wide").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.ceil(F.count(F.lit(1)) / limit).alias("_cuts"))
    span = (F.col("_hi") - F.col("_lo") + 1).cast("double") / F.col("_cuts")
    df = df.join(F.broadcast(cuts), "_wide").withColumn("_range", F.struct("_wide", F.floor((F.col("_key") - F.col("_lo")) / span).cast("int").alias("part"))).drop("_lo", "_hi", "_cuts", "_wide")
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("_range").over(whole.orderBy("_range")), F.max("_range").over(whole))
    firsts = df.groupBy("_range").agg(F.min("_key").alias("_least")).select("_range", "_least", before.alias("_before"))
    copies = F.when(F.col("_key") == F.col("_least"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    laid = df.join(F.broadcast(firsts), "_range").withColumn("_copy", F.explode(copies))
    laid = laid.withColumn("_at", F.when(F.col("_copy"), F.col("_before")).otherwise(F.col("_range")))
    follow = Window.partitionBy("_at").orderBy("_copy", "_key", *order)
    laid = laid.withColumns({f"next_{c}": F.lead(c).over(follow) for c in carried})
    return laid.filter(~F.col("_copy")).drop("_key", "_range", "_least", "_before", "_copy", "_at")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "bins"), "doc_id", ["text"], ["text", "bins"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = with_fingerprint(rows, "edited", "edited_bins")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op9_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

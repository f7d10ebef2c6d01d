"""Tags of texts by whole-word aliases and by keywords.

Nothing is compared pair by pair: texts are cut into runs of words, and the runs are
joined to the aliases by equality; misspelt runs meet names by pieces that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.shared import keep

#: An intent and the texts any of which shows it.
INTENTS = {
    "risk": ("risk", "spike", "probability", "chance", "how likely"),
    "forecast": ("forecast", "predict", "future", "trend", "next month", "price path"),
    "recommendation": ("recommend", "procurement", "buy", "should i", "lock", "advise", "advice"),
    "robustness": ("robust", "bandwidth", "placebo", "check", "reliable", "sensitivity"),
    "effect": ("effect", "causal", "rdd", "discontinuity", "jump", "cutoff", "deficiency"),
}


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case; any other mark but a blank is a word of its own, two blanks give an empty one."""
    return F.split(F.rtrim(F.regexp_replace(F.lower(text), "([^a-z0-9 ])", " $1 ")), " ")


def tagged(texts: DataFrame, key: str, aliases: DataFrame, longest: int, default: str | None = None) -> DataFrame:
    """key and tag: the name of the alias that stands first in the text, of several there the longest, or the default.

    ``texts`` has key and text, ``aliases`` alias and name; no alias has more than ``longest`` tokens.  An alias
    of several names takes the least.  A null or empty text has the default.
    """
    runs = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(F.col("_words"), F.col("_at") + 1, n), " "))
    words = texts.select(key, tokens(F.coalesce("text", F.lit(""))).alias("_words"))
    parts = words.select(key, "_words", F.posexplode("_words").alias("_at", "_word")).select(key, "_at", F.explode(F.array_distinct(runs)).alias("_run"))
    names = aliases.filter("alias <> ''").groupBy(F.array_join(tokens(F.col("alias")), " ").alias("_run")).agg(F.min("name").alias("_name"), F.max(F.length("alias")).alias("_len"))
    first = parts.join(names, "_run").groupBy(key).agg(F.min(F.struct("_at", (-F.col("_len")).alias("_less"), "_name")).alias("_best"))
    return texts.select(key).join(first, key, "left").select(key, F.coalesce("_best._name", F.lit(default)).alias("tag"))


def distinct(texts: DataFrame, a_task: int = 20_000) -> DataFrame:
    """(n, text): each distinct text once under a number, dealt evenly over tasks, however few files the texts came from; kept.

    What is said of a text is a function of it, so it is found once a text and joined to the rows by text.
    """
    own = keep(texts.select("text").distinct(), "distinct")
    parts = max(2 * texts.sparkSession.sparkContext.defaultParallelism, own.count() // a_task)
    return keep(own.repartition(parts).withColumn("n", F.monotonically_increasing_id()), "texts")


def letters(text: Column) -> Column:
    """Words of letters in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def grams(words: Column) -> Column:
    """(run, size, at) of the runs of two words, then of single ones, in text order; ``words`` is read at every run, so it should be a column that is there."""
    run = lambda size: F.transform(F.slice(words, 1, F.greatest(F.size(words) - size + 1, F.lit(0))), lambda _, i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("run"), F.lit(size).alias("size"), i.alias("at")))
    return F.concat(run(2), run(1))


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates (run, low) with the ratio of their matching characters."""
    for pdf in batches:
        yield pdf.assign(ratio=[SequenceMatcher(None, low, run).ratio() for run, low in zip(pdf["run"], pdf["low"], strict=True)])


def close_runs(runs: DataFrame, names: DataFrame, least: float = 0.85) -> DataFrame:
    """(run, name, ratio): the closest name of each distinct run, where twice the matching characters over all is ``least`` or more.

    So close a run and a name differ by at most k inserted or deleted characters, k known from the name's
    length; of k + 1 pieces of the name one stands in the run as it is, at most k places off.  Runs and
    names meet by such pieces only, and what meets is then compared.  Of equal ratios the greater name in lower case wins.
    """
    share = 2 * (1 - least) / least
    named = names.filter("name IS NOT NULL AND name <> ''").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    named = named.withColumn("size", F.length("low")).withColumn("k", F.floor(F.col("size") * share + 1e-9).cast("int"))
    cut = lambda i: F.floor(F.col("size") * i / (F.col("k") + 1)).cast("int")
    pieces = named.withColumn("i", F.explode(F.sequence(F.lit(0), "k"))).withColumns({"at": cut(F.col("i")), "end": cut(F.col("i") + 1)})
    pieces = pieces.select("low", "size", "k", "at", F.expr("substring(low, at + 1, end - at)").alias("piece")).filter("piece <> ''")
    sizes = sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())  # a few lengths
    if not sizes:
        return runs.sparkSession.createDataFrame([], "run string, name string, ratio double")
    own = runs.select("run").distinct().withColumn("length", F.length("run"))
    parts = own.select("run", "length", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).filter("length >= n").select("run", "length", "n", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("n"))).alias("place"))
    parts = parts.select("run", "length", "place", F.expr("substring(run, place + 1, n)").alias("piece"))
    met = parts.join(pieces, "piece").filter(F.abs(F.col("place") - F.col("at")) <= F.col("k")).filter(2 * F.least("size", "length") >= (least - 1e-9) * (F.col("size") + F.col("length")))
    found = met.select("run", "low").distinct().mapInPandas(_close, "run string, low string, ratio double").filter(F.col("ratio") >= least)
    return found.join(named.select("low", "name"), "low").groupBy("run").agg(F.max(F.struct("ratio", "low", "name")).alias("best")).select("run", "best.name", "best.ratio")


def fuzzy(texts: DataFrame, key: str, names: DataFrame, least: float = 0.85) -> DataFrame:
    """key and tag: the name closest to the first run of the text (pairs of words before single ones) that is close to one; texts without one have no row."""
    words = texts.select(key, letters(F.col("text")).alias("_words"))
    parts = words.select(key, F.explode(grams(F.col("_words"))).alias("g")).select(key, "g.*")
    near = parts.join(close_runs(parts, names, least), "run")
    return near.groupBy(key).agg(F.min(F.struct((-F.col("size")).alias("less"), "at", "name")).alias("best")).select(key, F.col("best.name").alias("tag"))


def listed(texts: DataFrame, key: str, names: DataFrame, longest: int) -> DataFrame:
    """key and name: the first in the list's order (names: name, place) that the text has as whole words."""
    runs = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(F.col("_words"), F.col("_at") + 1, n), " "))
    words = texts.select(key, tokens(F.coalesce("text", F.lit(""))).alias("_words"))
    parts = words.select(key, "_words", F.posexplode("_words").alias("_at", "_word")).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    known = names.filter("name <> ''").select(F.array_join(tokens(F.col("name")), " ").alias("_run"), "name", "place")
    return parts.join(known, "_run").groupBy(key).agg(F.min(F.struct("place", "name")).alias("best")).select(key, "best.name")


def intents(text: Column) -> dict[str, Column]:
    """A flag an intent; where none shows, effect, forecast and risk."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = {k: F.lit(False) for k in INTENTS}
    for k, needles in INTENTS.items():
        for x in needles:
            found[k] = found[k] | low.contains(x)
    none = F.lit(True)
    for c in found.values():
        none = none & ~c
    return {k: (c | none) if k in ("effect", "forecast", "risk") else c for k, c in found.items()}

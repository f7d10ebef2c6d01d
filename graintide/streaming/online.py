"""Online detectors: the steps of graintide.functions.series kept as state of a stream, a small JSON text a key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graintide.functions.series import STEPS

ROWS = "commodity string, t long, value double, guess double"
FOUND = "commodity string, t long, one double, two double, three double"


def folded(key: str, rows: pd.DataFrame, rule: str, state: dict) -> pd.DataFrame:
    """The rule's outputs over rows in order of t; state moves on."""
    rows = rows.sort_values("t")
    got = [STEPS[rule](state, v, g) for v, g in zip(rows["value"], rows["guess"], strict=True)]
    return pd.DataFrame({"commodity": key, "t": rows["t"].to_numpy(), **{c: [x[i] for x in got] for i, c in enumerate(("one", "two", "three"))}})


def batch(rows: DataFrame, rule: str) -> DataFrame:
    """The rule folded over each commodity's whole series (commodity, t, value, guess)."""
    return rows.groupBy("commodity").applyInPandas(lambda key, pdf: folded(key[0], pdf, rule, {}), FOUND)


def stream(rows: DataFrame, rule: str) -> DataFrame:
    """The same as rows arrive; a batch must not bring rows older than those of its key before."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {}
        yield folded(key[0], pd.concat(list(parts)), rule, own)
        state.update((json.dumps(own),))

    return rows.groupBy("commodity").applyInPandasWithState(step, FOUND, "state string", "append", GroupStateTimeout.NoTimeout)


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Files of ROWS as a stream, one a batch, oldest first."""
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)

"""Spike and loss classifiers, risk scores, safe discounts and lag forecasts: one model pooled over all keys, trained by Spark's own learners."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.shared import folder, keep

ROUNDS, DEPTH, RATE, SEED = 20, 4, 0.1, 7


def common(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """rows with all but the ``most`` frequent values of a column put together as Other."""
    top = rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(most).select(F.col(column).alias("_top"))
    return rows.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(column, F.coalesce("_top", F.lit("Other"))).drop("_top")


def split(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Four fifths to train on and a fifth to test on, by a hash of the key: the same for each label's rows up to chance, and on each run."""
    part = F.pmod(F.xxhash64(*key), F.lit(5))
    return rows.filter(part > 0), rows.filter(part == 0)


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """rows with a column weight: rows of label 1 weigh as much as all others together."""
    n, ones = rows.agg(F.count("*"), F.sum(label)).first()
    return rows.withColumn("weight", F.when(F.col(label) == 1, F.lit((n - ones) / max(ones, 1))).otherwise(F.lit(1.0)))


#: Rows that one task of a learner holds at most, up to chance: as features they take some hundred bytes each.
TASK_ROWS = 300_000
#: Rows that make up a task of the loss learners at least, up to chance: a training starts some thousand jobs, each with all tasks.
FEW_ROWS = 30_000


def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows dealt by a hash of the key, so that a task holds at most about ``TASK_ROWS``; fewer rows stay as they are.

    The rows are read as a small file's columns but held as features, so the file's parts may be too large by then.
    """
    parts = -(-rows.count() // TASK_ROWS)
    return rows if parts <= 1 else rows.repartition(parts, *key)


def classifier(words: list[str], numbers: list[str], label: str, learner: GBTClassifier | LogisticRegression) -> Pipeline:
    """Words as indicators and numbers beside them, then the learner; words that training has not seen have no indicator."""
    index = StringIndexer(inputCols=words, outputCols=[f"{w}_i" for w in words], handleInvalid="keep")
    ones = OneHotEncoder(inputCols=[f"{w}_i" for w in words], outputCols=[f"{w}_v" for w in words])
    gather = VectorAssembler(inputCols=[*numbers, *[f"{w}_v" for w in words]], outputCol="features")
    return Pipeline(stages=[index, ones, gather, learner.setLabelCol(label).setWeightCol("weight")])


def boosted(rounds: int = ROUNDS, depth: int = DEPTH) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=RATE, seed=SEED)


def probability() -> Column:
    return vector_to_array("probability")[1]


def auc(model: PipelineModel, rows: DataFrame, label: str, weight: str | None = None) -> float:
    judge = BinaryClassificationEvaluator(labelCol=label)
    return (judge.setWeightCol(weight) if weight else judge).evaluate(model.transform(rows))


def importances(model: PipelineModel, rows: DataFrame, names: int = 5) -> list[tuple[str, float]]:
    """The most important features of a boosted model, by the names the assembler gave them."""
    attrs = model.transform(rows.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    named = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    weights = model.stages[-1].featureImportances.toArray()
    order = sorted(range(len(weights)), key=lambda k: (-weights[k], k))[:names]
    return [(named[k], float(weights[k])) for k in order]


_saved: dict[tuple, str] = {}


def stamp(spark: SparkSession, sf_dir: str, sql: str) -> int:
    """A number that changes with the name, size or time of any file that the text reads."""
    text = views.cte(sql)
    files = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for t in views.TABLES if re.search(rf"\b{t}\b", text)]
    whole = files[0]
    for more in files[1:]:
        whole = whole.unionByName(more)
    return whole.agg(F.bit_xor(F.xxhash64(*whole.columns))).first()[0]


def saved_model(spark: SparkSession, sf_dir: str, sql: str, name: str, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The model of a text's rows, trained once a session and saved in the shared folder, and anew when the files that the text reads change."""
    key = (spark.sparkContext.applicationId, name, sf_dir, sql, stamp(spark, sf_dir, sql))
    if key not in _saved:
        path = folder(spark, name)
        train().save(path)
        _saved[key] = path
    return PipelineModel.load(_saved[key])


# ---- price spikes ----------------------------------------------------------------------------

SPIKES = """WITH p AS (SELECT * FROM panel WHERE n >= {least}),
 cutp AS (SELECT commodity, percentile_cont(0.75) WITHIN GROUP (ORDER BY avg_price) AS p75 FROM p GROUP BY 1 HAVING COUNT(*) >= 30),
 f AS (SELECT *, LAG(departure_pct, 1) OVER w AS lag1, LAG(departure_pct, 2) OVER w AS lag2, LAG(departure_pct, 3) OVER w AS lag3,
  LEAD(avg_price, 1) OVER w AS next_price, LEAD(year * 12 + month, 1) OVER w AS next_month,
  AVG(avg_price) OVER w3 AS roll, COALESCE(STDDEV_SAMP(avg_price) OVER w3 / NULLIF(AVG(avg_price) OVER w3, 0), 0) AS volatility
  FROM p WINDOW w AS (PARTITION BY commodity, state, district ORDER BY year, month),
  w3 AS (PARTITION BY commodity, state, district ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT f.*, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
 CASE WHEN {judged} >= p75 THEN 1 ELSE 0 END AS spike FROM f JOIN cutp USING (commodity) WHERE lag3 IS NOT NULL AND departure_pct IS NOT NULL{more}"""
#: The price that is judged: the month's own, or the next month's, where the series has that month.
HORIZONS = {0: {"judged": "avg_price", "more": ""}, 1: {"judged": "next_price", "more": " AND next_month = year * 12 + month + 1"}}
SPIKE_NUMBERS = ["departure_pct", "lag1", "lag2", "lag3", "roll", "volatility", "month_sin", "month_cos"]
SPIKE_KEY = ["commodity", "state", "district", "year", "month"]


def spike_rows(spark: SparkSession, sf_dir: str, least: int = 1, horizon: int = 0) -> DataFrame:
    """The panel's months of at least ``least`` prices with their features and whether the price is in its commodity's top quarter.

    At horizon 0 that is the month's own price, which the features ``roll`` and ``volatility`` hold too; at horizon 1
    the next month's, known for months that have a next one.
    """
    sql = SPIKES.format(least=least, **HORIZONS[horizon])
    return common(keep(views.run(spark, sf_dir, sql), "spikes").withColumn("place", F.col("district")), "place")


def spike_model(rows: DataFrame, rounds: int = ROUNDS) -> PipelineModel:
    return classifier(["commodity", "place"], SPIKE_NUMBERS, "spike", boosted(rounds)).fit(weighted(rows, "spike"))


def saved_spike_model(spark: SparkSession, sf_dir: str, rows: DataFrame, horizon: int = 0) -> PipelineModel:
    """The model of the training part of ``spike_rows``, shared by the queries that score with it."""
    sql = SPIKES.format(least=1, **HORIZONS[horizon])
    return saved_model(spark, sf_dir, sql, "spike_model", lambda: spike_model(split(rows, SPIKE_KEY)[0]))


def _figures(spark: SparkSession, found: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(found, "name string, value double")


@registry.register("spike_classifier")
def spike_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out area under the curve, rows and the five most important features.  Too few rows give an empty result."""
    rows = spike_rows(spark, sf_dir)
    train, test = split(rows, SPIKE_KEY)
    if train.select("spike").distinct().count() < 2 or test.select("spike").distinct().count() < 2:
        return _figures(spark, [])
    model = saved_spike_model(spark, sf_dir, rows)
    found = [("auc", auc(model, test, "spike")), ("train_rows", float(train.count())), ("test_rows", float(test.count()))]
    return _figures(spark, found + [(f"importance of {k}", v) for k, v in importances(model, train)])


@registry.register("spike_horizons")
def spike_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out area, rows and share of spikes where the month itself is judged and where the next one is; too few rows of a horizon give none."""
    found = []
    for horizon in HORIZONS:
        rows = spike_rows(spark, sf_dir, horizon=horizon)
        train, test = split(rows, SPIKE_KEY)
        if train.select("spike").distinct().count() < 2 or test.select("spike").distinct().count() < 2:
            continue
        model = saved_spike_model(spark, sf_dir, rows, horizon)
        n, share = rows.agg(F.count("*"), F.avg("spike")).first()
        found.append((horizon, n, float(share), auc(model, test, "spike")))
    return spark.createDataFrame(found, "horizon int, n long, spike_share double, auc double")


def risk_scores(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """The probability of a spike, in per cent, of each district's newest month, beside its commodity's mean, least and greatest."""
    newest = Window.partitionBy("commodity", "state", "district").orderBy(F.desc("year"), F.desc("month"))
    last = rows.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
    scored = model.transform(last).select(*SPIKE_KEY, F.round(probability() * 100, 1).alias("risk_score"))
    whole = scored.groupBy("commodity").agg(F.round(F.avg("risk_score"), 1).alias("overall"), F.max("risk_score").alias("highest"), F.min("risk_score").alias("lowest"))
    return scored.join(whole, "commodity")


@registry.register("spike_risk_score")
def spike_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every district's spike risk in its newest month."""
    rows = spike_rows(spark, sf_dir)
    if rows.select("spike").distinct().count() < 2:
        return spark.createDataFrame([], "commodity string, state string, district string, year int, month int, risk_score double, overall double, highest double, lowest double")
    return risk_scores(rows, saved_spike_model(spark, sf_dir, rows))


@registry.register("top_risk_districts")
def top_risk_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five districts of each commodity with the greatest spike risk."""
    order = Window.partitionBy("commodity").orderBy(F.desc("risk_score"), "state", "district")
    return spike_risk_score(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 5")


# ---- losses and discounts --------------------------------------------------------------------

LOSS_WORDS = ["category", "sub_category", "region", "segment", "ship_mode"]
LOSS_NUMBERS = ["discount", "quantity", "shipping_delay"]
COMBO = ["category", "sub_category", "region", "segment"]
#: Profit of a sale with gain and with loss where a segment has none of these, steps and greatest discount of the scan.
GAIN, LOSS, STEPS, GREATEST = 50.0, -50.0, 20, 0.8


SALES = "SELECT order_id, line_no, category, sub_category, region, segment, ship_mode, CAST(discount AS DOUBLE) AS discount, CAST(quantity AS DOUBLE) AS quantity, CAST(DATEDIFF(ship_date, order_date) AS DOUBLE) AS shipping_delay, CAST(profit AS DOUBLE) AS profit, is_loss FROM sales"
SALE_KEY = ["order_id", "line_no"]


def loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the classifier's features."""
    return keep(views.run(spark, sf_dir, SALES), "sales")


def loss_cells(sales: DataFrame) -> DataFrame:
    """One row, n of them, of all sales that are alike to a learner: the same features, label and part.

    ``part`` is test for the fifth that ``split`` holds out, validation for a fifth of the others, else train.
    No sale is left out; an area, a tree or a regression over rows that weigh n is that over the sales.
    """
    held, valid = F.pmod(F.xxhash64(*SALE_KEY), F.lit(5)), F.pmod(F.xxhash64(*SALE_KEY, F.lit("validation")), F.lit(5))
    part = F.when(held == 0, "test").when(valid == 0, "validation").otherwise("train")
    return keep(sales.groupBy(*LOSS_WORDS, *LOSS_NUMBERS, "is_loss", part.alias("part")).agg(F.count("*").cast("double").alias("n")), "cells")


def two_labels(*parts: DataFrame) -> bool:
    return all(x.select("is_loss").distinct().count() > 1 for x in parts)


def _balanced(train: DataFrame) -> DataFrame:
    """Training rows with their weight: n, and rows of label 1 as much as all others together."""
    rows = train if "n" in train.columns else train.withColumn("n", F.lit(1.0))
    n, ones = rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("is_loss"))).first()
    rows = dealt(rows.withColumn("weight", F.col("n") * F.when(F.col("is_loss") == 1, F.lit((n - ones) / max(ones, 1.0))).otherwise(F.lit(1.0))), [*LOSS_WORDS, *LOSS_NUMBERS])
    return rows.coalesce(max(1, -(-rows.count() // FEW_ROWS)))


def categories(train: DataFrame) -> tuple[PipelineModel, int]:
    """Features for trees: each word is one category, not an indicator a value, so a row is eight numbers; and the bins that the categories need."""
    index = StringIndexer(inputCols=LOSS_WORDS, outputCols=[f"{w}_i" for w in LOSS_WORDS], handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    gather = VectorAssembler(inputCols=[*LOSS_NUMBERS, *[f"{w}_i" for w in LOSS_WORDS]], outputCol="features")
    return PipelineModel([index, gather]), max(32, *[len(x) + 1 for x in index.labelsArray])


def _fitted(train: DataFrame, learner: GBTClassifier | LogisticRegression) -> PipelineModel:
    rows = _balanced(train)
    if isinstance(learner, LogisticRegression):
        return classifier(LOSS_WORDS, LOSS_NUMBERS, "is_loss", learner).fit(rows)
    encoder, bins = categories(train)
    return PipelineModel([*encoder.stages, learner.setLabelCol("is_loss").setWeightCol("weight").setMaxBins(bins).fit(encoder.transform(rows))])


def loss_learners(depths: Sequence[int] = (3, 5)) -> dict[str, GBTClassifier | LogisticRegression]:
    """The loss classifier's candidates."""
    return {f"trees of depth {d}": boosted(depth=d) for d in depths} | {"logistic regression": LogisticRegression(maxIter=50)}


def _loss_model(train: DataFrame, learner: GBTClassifier | LogisticRegression | dict[str, GBTClassifier | LogisticRegression], held: DataFrame | None = None) -> PipelineModel:
    """The learner's model, or of several the one of the greatest area on ``held``; ties, and a part of one label, go to the first."""
    if not isinstance(learner, dict):
        return _fitted(train, learner)
    models = [_fitted(train, x) for x in learner.values()]
    return max(models, key=lambda m: auc(m, held, "is_loss", "n")) if two_labels(held) else models[0]


@registry.register("loss_classifier")
def loss_classifier(spark: SparkSession, sf_dir: str, depths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Boosted trees of each depth and a logistic regression by their held-out area, precision, recall and F1; ``chosen`` marks the best area."""
    cells = loss_cells(views.run(spark, sf_dir, SALES))
    train, test = cells.filter("part <> 'test'"), cells.filter("part = 'test'")
    if not two_labels(train, test):
        return spark.createDataFrame([], "model string, auc double, precision double, recall double, f1 double, chosen boolean")
    found = []
    for name, learner in loss_learners(depths).items():  # a few models, not rows
        model = _fitted(train, learner)
        hit = model.transform(test).agg(F.sum(F.expr("CASE WHEN prediction = 1 AND is_loss = 1 THEN n ELSE 0 END")), F.sum(F.expr("prediction * n")), F.sum(F.expr("is_loss * n"))).first()
        precision, recall = hit[0] / max(hit[1], 1.0), hit[0] / max(hit[2], 1)
        found.append((name, auc(model, test, "is_loss", "n"), precision, recall, 2 * precision * recall / max(precision + recall, 1e-9)))
    best = max(x[1] for x in found)
    return spark.createDataFrame([(*x, x[1] == best) for x in found], "model string, auc double, precision double, recall double, f1 double, chosen boolean")


def first_rounds(model: GBTClassificationModel, rows: DataFrame, rounds: Sequence[int]) -> DataFrame:
    """rows with ``margin_n``, the weighted sum of the first n trees, for each n of ``rounds``: what a model of n rounds gives, since no tree looks ahead."""
    jvm, shown = rows.sparkSession.sparkContext._jvm, rows.columns
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    for n in rounds:
        trees, weights = JavaWrapper._new_java_array([t._java_obj for t in model.trees[:n]], kind), JavaWrapper._new_java_array(model.treeWeights[:n], jvm.double)
        made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2)  # PySpark has no call for it
        part = GBTClassificationModel(made).setFeaturesCol(model.getFeaturesCol()).setRawPredictionCol(f"raw_{n}").setProbabilityCol("").setPredictionCol("")
        rows = part.transform(rows).withColumn(f"margin_{n}", vector_to_array(f"raw_{n}")[1])
    return rows.select(*shown, *[f"margin_{n}" for n in rounds])


#: The grid's rounds, depths and rates; and the training rows, of all models at a time, that the grid holds.
GRID = ((100, 200), (3, 5, 7), (0.05, 0.1))
TOGETHER = 4_000_000


def grid_scores(rows: DataFrame, rounds: Sequence[int] = GRID[0], depths: Sequence[int] = GRID[1], rates: Sequence[float] = GRID[2], parallel: int = 6) -> DataFrame:
    """Areas of boosted trees under every combination, ``parallel`` of them trained at a time, or fewer where rows are many; ``chosen`` marks the best on the validation rows.

    Each depth and rate is trained once, to the most rounds; fewer rounds are its first trees.
    A fifth of the rows by key is for testing and a fifth of the others for validation, so that the test area of
    the chosen one isn't the greatest of many.  Ties go to fewer rounds, then less depth, then the lower rate.  A part of
    one label only gives no row.
    """
    spark = rows.sparkSession
    shape = "rounds int, depth int, rate double, validation_auc double, test_auc double, chosen boolean"
    cells = loss_cells(rows)
    train, *held = [cells.filter(F.col("part") == x) for x in ("train", "validation", "test")]
    if not two_labels(train, *held):
        return spark.createDataFrame([], shape)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder(spark, "rounds"))  # else a round's task holds all rounds before it
    encoder, bins = categories(train)
    learner = boosted().setLabelCol("is_loss").setWeightCol("weight").setMaxBins(bins)
    known = encoder.transform(_balanced(train)).select("features", "is_loss", "weight")
    held = [encoder.transform(x).select("features", "is_loss", "n") for x in held]
    grid = ParamGridBuilder().addGrid(learner.maxIter, [max(rounds)]).addGrid(learner.maxDepth, list(depths)).addGrid(learner.stepSize, list(rates)).build()
    fits = learner.fitMultiple(known, grid)

    def one(_: int) -> list[tuple]:
        k, model = next(fits)
        cell = grid[k]
        scores = [first_rounds(model, x, rounds) for x in held]
        judges = [BinaryClassificationEvaluator(labelCol="is_loss", rawPredictionCol=f"margin_{n}", weightCol="n") for n in rounds]
        return [(n, cell[learner.maxDepth], cell[learner.stepSize], *[judge.evaluate(x) for x in scores]) for n, judge in zip(rounds, judges, strict=True)]

    with ThreadPool(max(1, min(parallel, TOGETHER // train.count()))) as pool:
        found = sorted(row for rows in pool.map(one, range(len(grid)), chunksize=1) for row in rows)
    best = min(range(len(found)), key=lambda k: (-found[k][3], k))
    return spark.createDataFrame([(*x, k == best) for k, x in enumerate(found)], shape)


@registry.register("loss_grid")
def loss_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve scores of the loss classifier, of 100 and 200 rounds."""
    return grid_scores(views.run(spark, sf_dir, SALES))


def discount_scan(sales: DataFrame, model: PipelineModel, least: int = 5, quantity: float = 3.0, delay: float = 4.0) -> DataFrame:
    """Loss risk and expected profit of every segment at each step of the scan, shipped in the segment's commonest mode.

    A segment of fewer than ``least`` sales takes the mean gain and loss of its category and region, and where these have fewer too, the fixed ones.
    """
    gains, losses = F.when(F.col("profit") >= 0, F.col("profit")), F.when(F.col("profit") < 0, F.col("profit"))
    own = sales.groupBy(*COMBO).agg(F.count("*").alias("n"), F.sum(gains).alias("_g"), F.count(gains).alias("_ng"), F.sum(losses).alias("_l"), F.count(losses).alias("_nl"), F.mode("ship_mode", True).alias("ship_mode"))
    wider = Window.partitionBy("category", "region")
    both = own.select("*", *[F.sum(c).over(wider).alias(f"_w{c}") for c in ("n", "_g", "_ng", "_l", "_nl")])
    mean = lambda total, n, other: F.coalesce(F.when(F.col("n") >= least, F.try_divide(total, n)).when(F.col("_wn") >= least, F.try_divide(f"_w{total}", f"_w{n}")), F.lit(other))
    stats = both.select(*COMBO, "n", "ship_mode", mean("_g", "_ng", GAIN).alias("gain"), mean("_l", "_nl", LOSS).alias("loss"))
    steps = stats.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    asked = steps.select("*", (F.col("step") * GREATEST / (STEPS - 1)).alias("discount"), F.lit(quantity).alias("quantity"), F.lit(delay).alias("shipping_delay"))
    risk = probability()
    return model.transform(asked).select(*COMBO, "n", "step", "discount", risk.alias("loss_risk"), ((1 - risk) * F.col("gain") + risk * F.col("loss")).alias("expected_profit"))


def safe_discounts(scan: DataFrame, least: int = 5) -> DataFrame:
    """The last discount of each segment of at least ``least`` sales before the expected profit first falls below zero; none where it does at once."""
    bad = F.coalesce(F.min(F.when(F.col("expected_profit") < 0, F.col("step"))), F.lit(STEPS))
    by = scan.filter(F.col("n") >= least).groupBy(*COMBO, "n").agg(F.greatest(bad - 1, F.lit(0)).alias("safe_step"), F.min_by("loss_risk", "step").alias("base_risk"))
    return by.select(*COMBO, "n", F.round(F.col("safe_step") * GREATEST * 100 / (STEPS - 1), 1).alias("safe_discount_pct"), F.round(F.col("base_risk") * 100, 1).alias("base_risk_pct"))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's scan by the model that ``loss_classifier`` marks as chosen."""
    sales = loss_rows(spark, sf_dir)
    if not two_labels(sales):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COMBO) + ", n bigint, step int, discount double, loss_risk double, expected_profit double")

    def train() -> PipelineModel:
        cells = loss_cells(sales)
        return _loss_model(cells.filter("part <> 'test'"), loss_learners(), cells.filter("part = 'test'"))

    return discount_scan(sales, saved_model(spark, sf_dir, SALES, "loss_model", train))


@registry.register("safe_discount")
def safe_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's scan of discounts, with its greatest safe discount: the last one before the expected profit first falls below zero."""
    by = Window.partitionBy(*COMBO)
    scan = _scan(spark, sf_dir)
    first = F.coalesce(F.min(F.when(F.col("expected_profit") < 0, F.col("step"))).over(by), F.lit(STEPS))
    safe = scan.withColumn("_safe", F.greatest(first - 1, F.lit(0)))
    return safe.select(*scan.columns, F.round(F.col("_safe") * GREATEST * 100 / (STEPS - 1), 1).alias("safe_discount_pct"), F.max(F.when(F.col("step") == F.col("_safe"), F.col("loss_risk"))).over(by).alias("safe_loss_risk"))


@registry.register("batch_safe_discounts")
def batch_safe_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's greatest safe discount."""
    return safe_discounts(_scan(spark, sf_dir))


# ---- lag regression --------------------------------------------------------------------------


def lag_forecast(months: DataFrame, lags: int = 12, steps: int = 6) -> DataFrame:
    """The next ``steps`` months of each key by one regression of the price on its last ``lags``, in shares of the key's mean.

    ``months`` has key, t (gapless numbers of months) and value.  Each forecast is put before the values that
    the next one reads.  Keys of at most ``lags`` months, and tables without longer ones, give no rows.
    """
    by = Window.partitionBy("key")
    part = months.withColumn("mean", F.avg("value").over(by)).filter("mean > 0").withColumn("y", F.col("value") / F.col("mean"))
    order = by.orderBy("t")
    before = part.select("key", "t", "mean", "y", *[F.lag("y", k).over(order).alias(f"l{k}") for k in range(1, lags + 1)], F.lead("t").over(order).isNull().alias("last"))
    rows = keep(before.filter(F.col(f"l{lags}").isNotNull()), "lags")
    kind = "key string, step int, t bigint, forecast double"
    if rows.isEmpty():
        return months.sparkSession.createDataFrame([], kind)
    model = LinearRegression(labelCol="y", regParam=1e-6).fit(VectorAssembler(inputCols=[f"l{k}" for k in range(1, lags + 1)], outputCol="features").transform(rows))
    weights = F.array(*[F.lit(float(x)) for x in model.coefficients])

    def grow(known: Column, _: Column) -> Column:
        terms = F.zip_with(weights, F.slice(known, 1, lags), lambda w, x: w * x)
        return F.concat(F.array(F.aggregate(terms, F.lit(float(model.intercept)), lambda a, x: a + x)), known)

    known = F.array("y", *[F.col(f"l{k}") for k in range(1, lags)])
    path = F.reverse(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), known, grow), 1, steps))
    return rows.filter("last").select("key", "t", "mean", F.posexplode(path).alias("k", "share")).select("key", (F.col("k") + 1).alias("step"), (F.col("t") + F.col("k") + 1).alias("t"), (F.col("share") * F.col("mean")).alias("forecast"))


@registry.register("lag_regression_forecast")
def lag_regression_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months ahead of every commodity's national series."""
    return lag_forecast(views.run(spark, sf_dir, "SELECT commodity AS key, CAST(year * 12 + month AS BIGINT) AS t, avg_price AS value FROM national"))

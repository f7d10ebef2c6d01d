"""Sales that are alike to a learner as one weighted row, trees over categories, the grid's rounds and the scan's rules."""

import pytest
from pyspark.sql import functions as F

from graintide.plans import learning

SF = "/root/testdata/sf0.001"
SHAPE = ", ".join(f"{c} string" for c in learning.LOSS_WORDS) + ", discount double, quantity double, shipping_delay double, profit double, is_loss int"


def sales(spark, times):
    rows = spark.range(800).select(
        *[F.format_string("%s%d", F.lit(c), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(3))).alias(c) for c in learning.LOSS_WORDS], ((F.col("id") * 7) % 11 / 20).alias("discount"),
        (F.col("id") % 5).cast("double").alias("quantity"), (F.col("id") % 7).cast("double").alias("shipping_delay"),
    ).withColumn("is_loss", ((F.col("discount") > 0.3) != (F.col("category") == "category1")).cast("int"))
    return rows.crossJoin(spark.range(times)).select("*", F.monotonically_increasing_id().alias("order_id"), F.lit(1).alias("line_no"))


def test_alike_sales_are_one_weighted_row_and_train_the_same_model(spark):
    rows = sales(spark, 8)
    cells = learning.loss_cells(rows)
    assert cells.agg(F.sum("n")).first()[0] == rows.count() == 6400 and cells.count() < 2400
    train, test = (learning.split(rows, learning.SALE_KEY), cells.filter("part <> 'test'"))
    for learner in (learning.boosted(3, 2), learning.LogisticRegression(maxIter=20)):
        whole, few = learning._fitted(train[0], learner), learning._fitted(test, learner)
        both = whole.transform(train[1]).select(*learning.SALE_KEY, learning.probability().alias("a")).join(few.transform(train[1]).select(*learning.SALE_KEY, learning.probability().alias("b")), learning.SALE_KEY)
        assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-4
        assert learning.auc(few, train[1], "is_loss") == pytest.approx(learning.auc(few, cells.filter("part = 'test'"), "is_loss", "n"), abs=1e-9)


def test_a_word_is_one_feature_of_a_tree(spark):
    model = learning._fitted(learning.loss_cells(sales(spark, 1)), learning.boosted(2, 2))
    assert model.stages[-1].numFeatures == len(learning.LOSS_WORDS) + len(learning.LOSS_NUMBERS)


def test_many_rows_are_trained_fewer_at_a_time(spark, monkeypatch):
    pools, own = [], learning.ThreadPool
    monkeypatch.setattr(learning, "ThreadPool", lambda n: pools.append(n) or own(n))
    monkeypatch.setattr(learning, "TOGETHER", 1000)
    learning.grid_scores(sales(spark, 1), rounds=(1,), depths=(1, 2), rates=(0.1,))
    assert pools == [1]


def test_the_grid_takes_all_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(learning, "grid_scores", lambda rows, rounds=learning.GRID[0], *more, **named: asked.append(tuple(rounds)))
    learning.loss_grid(spark, SF)
    assert asked == [(100, 200)]


def test_the_scan_takes_the_best_of_the_classifiers_models(spark):
    cells = learning.loss_cells(sales(spark, 2))
    train, test = cells.filter("part <> 'test'"), cells.filter("part = 'test'")
    learners = {"one leaf": learning.boosted(1, 1), "two": learning.boosted(3, 3)}
    best = max(learning.auc(learning._fitted(train, x), test, "is_loss", "n") for x in learners.values())
    assert learning.auc(learning._loss_model(train, learners, test), test, "is_loss", "n") == pytest.approx(best, abs=1e-9)
    assert list(learning.loss_learners()) == ["trees of depth 3", "trees of depth 5", "logistic regression"]


def test_small_segments_take_wider_means(spark):
    row = lambda c, s, p, n: [(c, s, "r", "g", "m", 0.1, 1.0, 2.0, p, int(p < 0))] * n
    rows = spark.createDataFrame(row("a", "x", 30.0, 4) + row("a", "x", -10.0, 2) + row("a", "y", 120.0, 2) + row("b", "z", 7.0, 1), SHAPE)
    model = learning._loss_model(rows, learning.boosted(1, 1))
    scan = learning.discount_scan(rows, model)
    found = {r.sub_category: r for r in scan.filter("step = 0").collect()}
    assert scan.count() == 60 and {k: r.n for k, r in found.items()} == {"x": 6, "y": 2, "z": 1}
    for name, gain, loss in (("x", 30.0, -10.0), ("y", 60.0, -10.0), ("z", learning.GAIN, learning.LOSS)):
        risk = found[name].loss_risk
        assert found[name].expected_profit == pytest.approx((1 - risk) * gain + risk * loss)
    assert [r.sub_category for r in learning.safe_discounts(scan).collect()] == ["x"]


def test_each_scan_has_its_safe_discount(spark):
    scan, best = learning.safe_discount(spark, SF), learning.batch_safe_discounts(spark, SF)
    named = scan.filter("n >= 5").select(*learning.COMBO, "n", "safe_discount_pct").distinct()
    assert named.exceptAll(best.select(*learning.COMBO, "n", "safe_discount_pct")).count() == 0 < best.count() == named.count()
    assert scan.filter("n < 5").count() > 0 == scan.filter("safe_loss_risk IS NULL").count()


def test_few_rows_make_few_tasks(spark):
    cells = learning.loss_cells(sales(spark, 1)).repartition(40)
    assert learning._balanced(cells).rdd.getNumPartitions() == 1

"""Classifiers, discounts, lag forecasts and tags on rows whose result is known."""

import math

from pyspark.sql import functions as F

from graintide.functions import tagging
from graintide.plans import learning

SF = "/root/testdata/sf0.001"


def test_spikes_are_found_and_scored(spark):
    figures = {x.name: x.value for x in learning.spike_classifier(spark, SF).collect()}
    assert figures["auc"] > 0.75 and figures["train_rows"] > 2 * figures["test_rows"] > 0
    assert sum(k.startswith("importance") for k in figures) == 5
    top = learning.top_risk_districts(spark, SF).toPandas()
    assert top.groupby("commodity").size().max() <= 5 and top.risk_score.between(0, 100).all()
    assert (top[top.place == 1].risk_score == top[top.place == 1].highest).all()


def test_losses_follow_the_discount(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("order_id"), F.lit(1).alias("line_no"), F.format_string("c%d", F.col("id") % 3).alias("category"), F.lit("s").alias("sub_category"),
        F.lit("r").alias("region"), F.lit("g").alias("segment"), F.lit("m").alias("ship_mode"), ((F.col("id") * 7) % 17 / 20).alias("discount"), F.lit(3.0).alias("quantity"), F.lit(4.0).alias("shipping_delay"),
    ).withColumn("is_loss", (F.col("discount") > 0.41).cast("int")).withColumn("profit", F.when(F.col("is_loss") == 1, -100.0).otherwise(100.0))
    model = learning._loss_model(rows, learning.boosted())
    assert learning.auc(model, rows, "is_loss") > 0.99
    scan = learning.discount_scan(rows, model)
    assert scan.count() == 60
    assert all(35 <= x.safe_discount_pct <= 43 for x in learning.safe_discounts(scan).collect())


def test_one_training_serves_the_queries_that_score(spark, monkeypatch):
    trained = []
    own = learning._loss_model
    monkeypatch.setattr(learning, "_loss_model", lambda *a: trained.append(1) or own(*a))
    monkeypatch.setattr(learning, "_saved", {})
    scan = learning.safe_discount(spark, SF)
    best = learning.batch_safe_discounts(spark, SF)
    assert len(trained) == 1 and learning.safe_discounts(scan).exceptAll(best).count() == 0 < best.count()
    learning.saved_model(spark, SF, learning.SALES + " WHERE discount > 0", "loss_model", lambda: own(learning.loss_rows(spark, SF), learning.boosted(2)))
    assert len(learning._saved) == 2


def test_a_changed_file_changes_the_stamp(spark, tmp_path):
    sql, place = "SELECT r_name FROM region", f"{tmp_path}/region.parquet"
    spark.range(3).write.parquet(place)
    before = learning.stamp(spark, str(tmp_path), sql)
    assert learning.stamp(spark, str(tmp_path), sql) == before
    spark.range(3).write.mode("append").parquet(place)
    assert learning.stamp(spark, str(tmp_path), sql) != before


def test_grid_has_a_score_for_each_combination(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("order_id"), F.lit(1).alias("line_no"), *[F.format_string("%s%d", F.lit(c), F.col("id") % 2).alias(c) for c in learning.LOSS_WORDS],
        ((F.col("id") * 7) % 17 / 20).alias("discount"), ((F.col("id") * 11) % 13).cast("double").alias("quantity"), F.lit(4.0).alias("shipping_delay"),
    ).withColumn("is_loss", ((F.col("discount") > 0.41) != (F.col("quantity") > 5)).cast("int"))
    found = learning.grid_scores(rows, rounds=(1, 4), depths=(1, 2), rates=(0.1,), parallel=2).toPandas()
    assert list(zip(found["rounds"], found.depth)) == [(1, 1), (1, 2), (4, 1), (4, 2)] and found.chosen.sum() == 1
    chosen = found[found.chosen].iloc[0]
    assert chosen.validation_auc == found.validation_auc.max() and chosen.depth == 2 and chosen.test_auc > 0.99
    assert found[found.depth == 1].test_auc.max() < 0.8
    assert learning.grid_scores(rows.filter("is_loss = 0"), rounds=(1,)).count() == 0 == learning.grid_scores(rows.limit(0), rounds=(1,)).count()


def test_next_months_spike_is_judged_by_the_next_month(spark):
    key = ["commodity", "state", "district"]
    own = {(*[r[c] for c in key], r.year * 12 + r.month): r.spike for r in learning.spike_rows(spark, SF).collect()}
    rows = learning.spike_rows(spark, SF, horizon=1).collect()
    assert rows and all(r.next_month == r.year * 12 + r.month + 1 for r in rows)
    both = [(r.spike, own[k]) for r in rows if (k := (*[r[c] for c in key], r.next_month)) in own]
    assert both and all(a == b for a, b in both)
    found = {r.horizon: r for r in learning.spike_horizons(spark, SF).collect()}
    assert set(found) == {0, 1} and found[1].n == len(rows) < found[0].n and found[1].auc < found[0].auc


def test_the_prefix_rule_stops_at_the_first_loss(spark):
    shape = [("a", "b", "c", "d", 9, k, k / 25, 0.1, -1.0 if k in bad else 1.0) for bad in ([4, 5],) for k in range(20)]
    shape += [("z", "b", "c", "d", 9, k, k / 25, 0.1, -1.0 if k == 0 else 1.0) for k in range(20)]
    shape += [("y", "b", "c", "d", 9, k, k / 25, 0.1, 1.0) for k in range(20)]
    scan = spark.createDataFrame(shape, "category string, sub_category string, region string, segment string, n bigint, step int, discount double, loss_risk double, expected_profit double")
    found = {x.category: x.safe_discount_pct for x in learning.safe_discounts(scan).collect()}
    assert found == {"a": 12.6, "z": 0.0, "y": 80.0}


def test_lag_regression_continues_a_wave(spark):
    wave = [(k, t, m * (2 + math.sin(2 * math.pi * t / 12))) for k, m in (("a", 10.0), ("b", 300.0)) for t in range(60)] + [("short", t, 1.0) for t in range(5)]
    found = learning.lag_forecast(spark.createDataFrame(wave, "key string, t bigint, value double")).collect()
    assert sorted((x.key, x.step) for x in found) == [(k, s) for k in "ab" for s in range(1, 7)]
    for x in found:
        scale = {"a": 10.0, "b": 300.0}[x.key]
        assert x.t == 59 + x.step and abs(x.forecast / scale - 2 - math.sin(2 * math.pi * x.t / 12)) < 0.02
    assert learning.lag_forecast(spark.createDataFrame([], "key string, t bigint, value double")).count() == 0


def test_whole_words_first_place_and_longest_alias(spark):
    aliases = spark.createDataFrame([("rice", "Paddy"), ("chilli", "Chili Red"), ("green chilli", "Green Chilli"), ("onion", "Onion"), ("paddy(common)", "Paddy")], "alias string, name string")
    said = ["price-spike of onion", "Green chilli or onion?", "green-chilli", "green  chilli", "PADDY(Common) rates", "", None, "no such thing", "rice"]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    found = {x.id: x.tag for x in tagging.tagged(texts, "id", aliases, 4, "Onion").collect()}
    assert [found[k] for k in range(9)] == ["Onion", "Green Chilli", "Chili Red", "Chili Red", "Paddy", "Onion", "Onion", "Onion", "Paddy"]


def test_intents(spark):
    texts = spark.createDataFrame([("Should I buy?",), ("placebo check of the jump",), (None,)], "text string")
    found = [tuple(x) for x in texts.select(*[c.alias(k) for k, c in tagging.intents(F.col("text")).items()]).collect()]
    assert found == [(False, False, True, False, False), (False, False, False, True, True), (True, True, False, False, True)]

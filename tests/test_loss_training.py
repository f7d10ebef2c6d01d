"""The loss grid's trainings and the rows that one task of a learner holds."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from graintide.plans import learning

SF = "/root/testdata/sf0.001"


def test_fewer_rounds_are_the_first_trees_and_tasks_hold_few_rows(spark, monkeypatch):
    rows = learning.loss_rows(spark, SF)
    train, test = learning.split(rows, learning.SALE_KEY)
    learner = learning.boosted(4, 2).setLabelCol("is_loss").setWeightCol("weight")
    encoder = Pipeline(stages=learning.classifier(learning.LOSS_WORDS, learning.LOSS_NUMBERS, "is_loss", learner).getStages()[:-1]).fit(train)
    known, held = encoder.transform(learning.weighted(train, "is_loss")), encoder.transform(test)
    whole = learner.fit(known)
    scored = learning.first_rounds(whole, held, (2, 4))
    for n in (2, 4):
        own = learner.copy({learner.maxIter: n}).fit(known)
        area = BinaryClassificationEvaluator(labelCol="is_loss", rawPredictionCol=f"margin_{n}").evaluate(scored)
        assert area == pytest.approx(learning.auc(own, held, "is_loss"), abs=1e-9)
    monkeypatch.setattr(learning, "TASK_ROWS", 500)
    sizes = [r["count"] for r in learning.dealt(rows, learning.SALE_KEY).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1000 and sum(sizes) == rows.count()

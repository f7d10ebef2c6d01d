import zlib

import numpy as np

from graintide.llm.mil_quality import FEATURES, Model, encoder, fit, op8_quality_classifier, score_documents, train

from .helpers import ROWS, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op8_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in rows["doc_id"]]).all()
    both = rows.merge(labels, on="doc_id")
    own = both[both["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.95
    bad, good = own[own["quality"] == 0]["score"], own[own["quality"] == 1]["score"]
    assert (np.subtract.outer(good.to_numpy(), bad.to_numpy()) > 0).mean() > 0.97


def test_gradient_learns_from_one_passage_in_many():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(1, 9), FEATURES)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), :3] += 6
        bags.append(bag)
        y.append(i % 2)
    model = fit(bags, np.array(y))
    assert ((model.score(bags) > 0.5) == np.array(y)).mean() > 0.95


def test_odd_rows(spark):
    model = train(frame(spark), spark.createDataFrame([(0, 1), (1, 1), (3, 0), (6, 0), (6, None), (7, 1), (7, 1)], "doc_id long, quality int"))
    got = score_documents(frame(spark), model).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {}
    for r, (k, t, *_) in zip(got, ROWS, strict=True):
        assert by.setdefault(t or "", r.score) == r.score
    assert score_documents(frame(spark, []), model).collect() == []
    assert train(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).score([encoder().encode("a")]).tolist() == [0.5]


def test_one_label_only():
    assert fit([encoder().encode("a b")], np.array([1])).score([encoder().encode("c")]).tolist() == [1.0]
    assert isinstance(fit([], np.array([])), Model)

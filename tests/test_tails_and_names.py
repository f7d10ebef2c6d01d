"""Tails against a dense search and known laws; misspelt names against a comparison of all pairs."""

import difflib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graintide.functions import tagging
from graintide.plans import tails

SF = "/root/testdata/sf0.001"


def drawn(rng, shape, scale, n):
    u = rng.random(n)
    return -scale * np.log(u) if shape == 0 else scale / shape * (u**-shape - 1)


def likelihood(x, shape, scale):
    z = 1 + shape * x / scale
    return -len(x) * np.log(scale) - (1 + 1 / shape) * np.log(z).sum() if (z > 0).all() else -np.inf


def test_likelihood_finds_planted_tails(spark):
    rng = np.random.default_rng(3)
    laws = {"heavy": (0.4, 2.0), "light": (-0.3, 1.0), "plain": (0.0, 5.0), "wide": (0.9, 100.0)}
    rows = [(k, float(x)) for k, (s, b) in laws.items() for x in drawn(rng, s, b, 4000)] + [("few", 1.0)] * 10 + [(None, float(x)) for x in drawn(rng, 0.2, 1.0, 100)]
    got = {r.k0: r for r in tails.pareto_tails(spark.createDataFrame(rows, "k0 string, x double"), ["k0"]).collect()}
    assert set(got) == {*laws, None}
    for k, (shape, scale) in laws.items():
        r = got[k]
        assert r["k"] == 4000 and not r.at_edge and r["shape"] == pytest.approx(shape, abs=0.06) and r["scale"] == pytest.approx(scale, rel=0.08)
        x = np.array([v for n, v in rows if n == k])
        near = [likelihood(x, r["shape"] + a, r["scale"] * b) for a in (-0.01, 1e-9, 0.01) for b in (0.99, 1, 1.01)]
        assert r.log_likelihood >= max(near) - 1e-3


def test_quantiles_beyond_the_sample(spark):
    x = -np.random.default_rng(9).standard_t(3, 3000) * 0.02
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "loss": x}))
    row = tails.beyond_sample(tails.tails(df, ["g"])).first()
    assert row["threshold"] == pytest.approx(np.quantile(x, 0.9)) and row["n"] == 3000 and row["k"] == 300
    assert row["var"] > row["threshold"] and row["es"] >= row["var"] and row["shape"] > 0
    assert abs((x > row["var"]).mean() - 0.01) < 0.004
    assert tails.tails(df.limit(50), ["g"]).collect() == [] and tails.beyond_sample(tails.tails(df, ["g"]), 0.6).first()["var"] is None
    with pytest.raises(ValueError):
        tails.beyond_sample(df, 1.0)


def plain(text, names):
    low = {}
    for n in sorted(names, reverse=True):
        low[n.lower()] = n
    words = re.findall(r"[a-z]+", (text or "").lower())
    for size in (2, 1):
        for i in range(len(words) - size + 1):
            if close := difflib.get_close_matches(" ".join(words[i : i + size]), list(low), n=1, cutoff=0.85):
                return low[close[0]]
    return None


def test_close_names_against_all_pairs(spark):
    names = ["Onion", "Tomato", "Green Chilli", "Cauliflower", "Soyabean", "Egg", "Pomegranate", "Bengal Gram", "Gram", "Turmeric", "Coriander", "Finger Millet", "Drumstick"]
    rng = np.random.default_rng(1)
    texts = ["", None, "the eggs are dear", "grean chili prices", "tomatos and onoin", "a pomegrante or culiflower", "price of tumeric", "nothing here", "bengal grams"]
    for n in names * 12:
        w = list(n)
        for _ in range(rng.integers(1, 3)):
            at = int(rng.integers(0, len(w)))
            w[at : at + rng.integers(0, 2)] = list(rng.choice(list("aeiotrs"), rng.integers(0, 2)))
        texts.append("what of " + "".join(w) + " now")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = tagging.fuzzy(df, "id", spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    got = {r.id: r.tag for r in found.collect()}
    want = {k: t for k, x in enumerate(texts) if (t := plain(x, names))}
    assert got == want and len(want) > 60
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert tagging.fuzzy(df, "id", spark.createDataFrame([], "name string")).collect() == []


def test_districts_in_the_lists_order(spark):
    texts = spark.createDataFrame([(1, "from Pune to New Delhi"), (2, "punes"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("New Delhi", 0), ("Pune", 1)], "name string, place int")
    assert [tuple(r) for r in tagging.listed(texts, "id", names, 2).collect()] == [(1, "New Delhi")]


def test_queries(spark):
    from graintide import registry

    found = registry.queries()
    rows = found["fuzzy_commodity_tags"](spark, SF).toPandas()
    typed = rows[rows["id"].str.startswith("typed")]
    assert rows["id"].is_unique and (typed["how"] == "close").mean() > 0.8 and typed["district"].notna().all()
    fits, risks = found["gpd_maximum_likelihood"](spark, SF).toPandas(), found["evt_var_es_likelihood"](spark, SF).toPandas()
    assert (fits["scale"] > 0).all() and (risks["es99"] >= risks["var99"]).all()


def test_each_text_is_tagged_once(spark, monkeypatch):
    from graintide import registry, views
    from graintide.plans import reports

    given = {}
    for step in ("tagged", "fuzzy", "listed"):
        own = getattr(tagging, step)
        monkeypatch.setattr(tagging, step, lambda texts, *more, step=step, own=own: own(given.setdefault(step, texts), *more))
    rows = registry.queries()["fuzzy_commodity_tags"](spark, SF).toPandas()
    said = views.run(spark, SF, f"{reports.TYPED} UNION ALL {reports.SAID}").toPandas()
    assert sorted(rows["id"]) == sorted(said["id"])
    # as many rows as distinct texts go into each step, dealt over tasks although the tables are single files
    n = said["text"].nunique(dropna=False)
    assert given["tagged"].count() == given["listed"].count() == n < len(said) and given["fuzzy"].count() < n
    assert given["tagged"].groupBy(F.spark_partition_id()).count().count() >= 4
    assert rows.merge(said, on="id").groupby("text")[["tag", "how", "district"]].nunique(dropna=False).max().max() == 1
    assert tagging.distinct(spark.createDataFrame([(1, None), (2, None), (3, "")], "id int, text string")).count() == 2

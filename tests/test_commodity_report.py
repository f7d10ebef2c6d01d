"""The report of six sections: its parts equal their queries, and a failing section leaves the others."""

import json

from pyspark.sql import functions as F

from graintide import registry
from graintide.plans import commodity

SF = "/root/testdata/sf0.001"
SHAPES = {"a": "p double", "b": "q double", "c": "s string"}


def _report(spark, **changed):
    names = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "commodity string")
    parts = {
        "a": lambda: spark.createDataFrame([("x", 1.0), ("y", None)], "commodity string, p double"),
        "b": lambda: spark.createDataFrame([("y", 2), (None, 3)], "commodity string, q int"),
        "c": lambda: spark.createDataFrame([("x", "u"), ("y", "v"), ("not listed", "w")], "commodity string, s string"),
    } | changed
    found = commodity.narrow(commodity.joined(names, parts, SHAPES)).collect()
    return {(r.commodity, r.section): (json.loads(r.content) if r.content else None, r.error) for r in found}


def test_sections_side_by_side(spark):
    found = _report(spark)
    assert len(found) == 6
    assert found["x", "a"] == ({"p": 1.0}, None) and found["y", "a"] == ({}, None)
    assert found["x", "b"] == (None, commodity.NO_ROW) and found["y", "b"] == ({"q": 2.0}, None)


def test_a_section_that_fails_leaves_the_others(spark):
    whole = _report(spark)

    def planning():
        raise RuntimeError("no such thing")

    late = lambda: spark.range(1).select(F.lit("x").alias("commodity"), F.expr("CAST(raise_error('late') AS DOUBLE)").alias("p"))
    twice = lambda: spark.createDataFrame([("x", 1.0), ("x", 2.0)], "commodity string, p double")
    lacking = lambda: spark.createDataFrame([("x", 1.0)], "commodity string, other double")
    for make, word in ((planning, "no such thing"), (late, ""), (twice, "several rows"), (lacking, "p")):
        found = _report(spark, a=make)
        for name in "xy":
            assert found[name, "a"][0] is None and word in found[name, "a"][1] and found[name, "a"][1] != commodity.NO_ROW
        assert {k: v for k, v in found.items() if k[1] != "a"} == {k: v for k, v in whole.items() if k[1] != "a"}


def test_report_of_the_tables(spark):
    names, makers = commodity.makers(spark, SF)

    def broken():
        raise RuntimeError("forced")

    report = commodity.joined(names, makers | {"dml": broken})
    found = {r.commodity: r for r in commodity.wide(report).collect()}
    assert len(found) == names.distinct().count()
    assert all("dml" in r.sections_failed.split(",") and r.theta is None for r in found.values())
    for section, key, column in (("conformal", "split_conformal", "half_width"), ("drift", "drift_report", "psi"), ("tail_risk", "tail_risk_report", "var95"), ("spec_curve", "spec_curve_summary", "median_effect")):
        own = {r.commodity: r[column] for r in registry.queries()[key](spark, SF).collect()}
        assert {k: r[column] for k, r in found.items() if section in r.sections_available.split(",")} == own
    for r in found.values():
        assert r.headline == commodity.SILENT or r.headline.endswith(".")
        assert ("month-end nowcast" in r.headline) == (r.nowcast is not None)
    assert any(r.headline != commodity.SILENT for r in found.values())


def test_no_commodities(spark):
    empty = spark.createDataFrame([], "commodity string")
    none = {k: (lambda: empty) for k in commodity.SECTIONS}
    assert commodity.wide(commodity.joined(empty, none)).count() == 0

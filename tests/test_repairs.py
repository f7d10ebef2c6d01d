"""Cleaning, merges, freshness lists and retail functions on hand-made rows."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from graintide import catalog, cleaning, discoveries, orders

D = datetime.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_states_and_precedence_of_lookups(spark):
    names = spark.createDataFrame([(" Orissa ",), ("DELHI",), ("Jammu & Kashmir ",), ("Goa",), (None,)], "s string")
    assert [r[0] for r in names.select(cleaning.canonical_state(F.col("s"))).collect()] == ["Odisha", "NCT of Delhi", "Jammu & Kashmir", "Goa", None]
    coords = spark.createDataFrame([("Nashik", "Old"), ("Puri", "orissa"), ("", "X"), ("Pune", "")], "district string, state string")
    archive = spark.createDataFrame([(" nashik", "Maharashtra"), ("Thane", "A"), ("thane", "B")], "district string, state string")
    manual = spark.createDataFrame([("Thane", "Manual")], "district string, state string")
    assert rows(cleaning.state_lookup(coords, archive)) == [("nashik", "Maharashtra"), ("puri", "Odisha"), ("thane", "B")]
    lookup = cleaning.state_lookup(coords, archive, manual)
    prices = spark.createDataFrame([(1, None, "NASHIK "), (2, " ", "Thane"), (3, "delhi", "Nashik"), (4, "", "Nowhere"), (5, None, None), (6, "Goa", "Panaji")], "id int, state string, district string")
    filled = cleaning.backfill_states(prices, lookup)
    assert rows(filled.select("id", "state", "state_from")) == [(1, "Maharashtra", "lookup"), (2, "Manual", "lookup"), (3, "NCT of Delhi", "own"), (4, None, "nothing"), (5, None, "nothing"), (6, "Goa", "own")]
    assert rows(cleaning.backfill_report(filled)) == [("NASHIK ", 1, True), ("Nowhere", 1, False), ("Thane", 1, True)]
    assert cleaning.backfill_states(prices.limit(0), lookup).collect() == []


def test_subdivision_by_exact_name_then_title_case(spark):
    places = spark.createDataFrame([("Madhya Pradesh", "Indore", "West"), ("Madhya Pradesh", "Indore", "East"), ("BIHAR", "gaya", "Bihar")], "state string, district string, sub_division string")
    prices = spark.createDataFrame([(1, "MADHYA PRADESH", "indore"), (2, "BIHAR", "gaya"), (3, "Bihar", "Gaya"), (4, None, "Indore")], "id int, state string, district string")
    assert rows(cleaning.to_subdivision(prices, places).select("id", "sub_division")) == [(1, "East"), (2, "Bihar")]
    assert {r.id: r.sub_division for r in cleaning.to_subdivision(prices, places, unmapped=True).collect()} == {1: "East", 2: "Bihar", 3: None, 4: None}


def test_date_summary_and_rain_rows(spark):
    raw = spark.createDataFrame([("2026-09-12",), ("13/09/2026",), ("05/05/2026",), ("",), (None,), ("x",), ("2030-01-01",), ("1800-01-01",)], "raw string")
    (got,) = cleaning.date_summary(raw, "raw", F.lit("2026-10-01").cast("date")).collect()
    assert got.asDict() == {"n": 8, "ok": 3, "missing": 2, "unparseable": 1, "future": 1, "impossible": 1, "rejected": 5, "ambiguous": 1}
    (none,) = cleaning.date_summary(raw.limit(0), "raw", F.lit("2026-10-01").cast("date")).collect()
    assert set(none.asDict().values()) == {0}
    rain = spark.createDataFrame([("A", 2000, 2, 5.0, math.nan), ("a", 2000, 1, -7.0, 3.0), ("A", 1999, 1, 201.0, 1.0), ("A", 2001, 1, math.nan, 1.0), ("B", 2000, 1, 1.0, 1.0)], "sub_division string, year int, month int, departure_pct double, mm double")
    assert [tuple(r) for r in cleaning.rainfall_rows(rain, "A", 5).collect()] == [("a", 2000, 1, -7.0, 3.0), ("A", 2000, 2, 5.0, None)]
    assert len(cleaning.rainfall_rows(rain, "A", 1).collect()) == 1


def test_union_difference_targets_and_options(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2, 0.5)], "k int, v double")
    assert rows(catalog.union_sources(a=a, b=b).select("source", "k", "s", "v")) == [("a", 1, "x", None), ("b", 2, None, 0.5)]
    wanted, found = spark.createDataFrame([("Onion",), (" onion",), ("Leek",), (None,)], "commodity string"), spark.createDataFrame([("ONION",), ("Rice",), ("",)], "commodity string")
    assert rows(catalog.difference(wanted, found, "commodity")) == [("Leek", "missing"), ("Onion", "present"), ("Rice", "unmatched")]
    assert [tuple(r) for r in catalog.targets_present(["Rice", "Leek", "ONION", "Rice"], found).collect()] == [(0, "Rice"), (2, "ONION")]
    fields = spark.createDataFrame([("new delhi",), ("new delhi",), ("PUNE",), ("agra",), ("",), (None,)], "district string")
    assert [tuple(r) for r in catalog.options(fields, "district", 2).collect()] == [(1, "New Delhi", 2), (2, "Pune", 1)]
    assert rows(catalog.options(fields, "district", 2, ["Nashik"])) == [(1, "New Delhi", 2), (2, "Pune", 1)]
    assert rows(catalog.options(fields.limit(0), "district", 2, ["Nashik", "Pune"])) == [(1, "Nashik", 0), (2, "Pune", 0)]


def test_first_writer_wins_and_last_replaces(spark):
    old = spark.createDataFrame([("a", 1, 10, 0), (None, 1, 11, 0)], "k string, m int, v int, t int")
    new = spark.createDataFrame([("a", 1, 20, 1), ("b", 1, 22, 2), ("b", 1, 21, 1), (None, 1, 23, 1)], "k string, m int, v int, t int")
    assert [tuple(r) for r in catalog.insert_or_ignore(old, new, ["k", "m"], ["t"]).collect()] == [("b", 1, 21, 1)]
    got = {(r.k, r.v) for r in catalog.replace_by_key(old, new, ["k", "m"], ["t"]).collect()}
    assert got == {("a", 20), ("b", 22), (None, 23)}
    assert {(r.k, r.v) for r in catalog.replace_by_key(old, new.limit(0), ["k", "m"], ["t"]).collect()} == {("a", 10), (None, 11)}


def test_staleness_and_kpis(spark):
    fresh = spark.createDataFrame([("Onion", D(2026, 9, 30), 5, "api"), ("Rice", D(2026, 9, 1), 7, ""), ("Leek", None, 1, "csv"), ("Kale", D(2026, 1, 1), 1, "api"), ("Yam", D(2026, 2, 1), 1, None)], "commodity string, latest_date date, n long, source_type string")
    now = F.lit("2026-10-01 12:00:00").cast("timestamp")
    got = rows(catalog.staleness(fresh, ["Onion", "Rice", "Leek", "Mango", "onion"], now, extras=1).select("commodity", "kind", "state"))
    assert got == [("kale", "extra", "stale"), ("leek", "watched", "stale"), ("mango", "watched", "missing"), ("onion", "watched", "fresh"), ("rice", "watched", "stale")]
    hours = {r.commodity: r.hours_ago for r in catalog.staleness(fresh, ["Onion"], now).collect()}
    assert hours["onion"] == 36 and set(hours) == {"onion", "rice", "kale", "yam"}
    (kpi,) = catalog.freshness_kpis(fresh, F.lit("2026-10-01").cast("date")).collect()
    assert tuple(kpi) == (5, 15, 1, "api, csv")


def test_audit_and_features(spark):
    df = spark.createDataFrame([(1, "p", 5.0, -1.0), (1, "p", 5.0, -1.0), (1, "p", 6.0, 2.0), (2, None, math.nan, 1.0)], "order_id int, product string, sales double, profit double")
    got = {(r["measure"], r["column"]): r["n"] for r in orders.audit(df, ["order_id", "product"]).collect()}
    assert got == {("rows", None): 4, ("losses", "profit"): 2, ("missing", "order_id"): 0, ("missing", "product"): 1, ("missing", "sales"): 1, ("missing", "profit"): 0, ("full duplicates", None): 1, ("key duplicates", None): 2}
    assert {r["n"] for r in orders.audit(df.limit(0), ["order_id"]).collect()} == {0}
    lines = spark.createDataFrame([(100.0, -20.0, 0.41, D(2026, 3, 5), D(2026, 3, 7)), (0.0, 1.0, 0.2, D(2026, 3, 5), D(2026, 3, 11)), (1.0, 1.0, 0.0, None, None)], "sales double, profit double, discount double, order_date date, ship_date date")
    a, b, c = orders.features(lines).collect()
    assert (a.profit_margin, a.discount_tier, a.order_month, a.order_quarter, a.order_month_name, a.order_year_month, a.is_loss, a.shipping_delay_cat) == (-20.0, "41%+", 3, 1, "Mar", "2026-03", 1, "Fast")
    assert abs(a.log_sales - math.log(101)) < 1e-12
    assert (b.profit_margin, b.discount_tier, b.shipping_delay_cat, c.discount_tier, c.order_year_month, c.shipping_delay_cat) == (None, "1-20%", "Slow", "0%", None, None)


def test_breakdown_and_order_counts(spark):
    df = spark.createDataFrame([(1, "A", "N", D(2026, 1, 1), D(2026, 1, 3), 60.0, 6.0), (1, "A", "S", D(2026, 1, 9), D(2026, 1, 10), 20.0, -9.0), (2, "B", "S", D(2026, 2, 1), D(2026, 2, 1), 20.0, 5.0)], "order_id int, category string, region string, order_date date, ship_date date, sales double, profit double")
    got = {(r.dimension, r.value): r for r in orders.breakdown(df, {"category": "category", "region": "region", "month": "date_format(order_date, 'yyyy-MM')"}).collect()}
    assert len(got) == 7
    assert (got["all", None].n, got["all", None].sales, got["all", None].delay_days, got["all", None].note) == (3, 100.0, 1.0, None)
    assert (got["category", "A"].share_pct, got["category", "A"].margin_pct, got["category", "A"].place, got["category", "A"].note) == (80.0, -3.75, 1, "loss making")
    assert (got["month", "2026-01"].note, got["month", "2026-02"].note, got["region", "S"].place) == ("peak", "lowest", 2)
    assert {(r.value, r.n_orders) for r in orders.distinct_orders(df).collect()} == {("A", 1), ("B", 1), (None, 2)}


def test_segment_profits_fall_back(spark):
    wide = [("C", f"s{i % 3}", "N", "X", p) for i, p in enumerate((1.0, 2.0, 3.0, -6.0, 0.0))]
    own = [("C", "own", "S", "X", p) for p in (10.0, 20.0, 30.0, 40.0, 50.0)]
    df = spark.createDataFrame([*wide, *own, ("D", "t", "N", "X", 9.0)], "category string, sub_category string, region string, segment string, profit double")
    got = {r.sub_category: (r.basis, r.n_used, r.gain, r.loss) for r in orders.segment_profits(df).collect()}
    assert got["own"] == ("segment", 5, 30.0, -50.0)
    assert got["s0"] == got["s2"] == ("category and region", 5, 1.5, -6.0)
    assert got["t"] == ("default", 0, 50.0, -50.0)


def test_monthly_sales_hold_out(spark):
    df = spark.createDataFrame([(D(2025, m, 3), 2.0) for m in range(1, 13)] + [(D(2025, 12, 9), 3.0), (None, 9.0)], "order_date date, sales double")
    got = {r.month: (r.y, r.part) for r in orders.monthly_sales(df).collect()}
    assert got[D(2025, 12, 1)] == (5.0, "test") and got[D(2025, 6, 1)] == (2.0, "train") and sum(p == "test" for _, p in got.values()) == 6


def index(old, new, bins=10):
    """Plain stability index over percentile or value bins with an open last bin."""
    values = np.unique(old)
    edges = values if len(values) < bins else np.unique(np.percentile(old, np.linspace(0, 100, bins + 1)))
    ends = [*edges[1:], np.inf]
    p = [max(0.001, np.mean((old >= a) & (old < b))) for a, b in zip(edges, ends, strict=True)]
    q = [max(0.001, np.mean((new >= a) & (new < b))) for a, b in zip(edges, ends, strict=True)]
    return len(edges), sum((x - y) * math.log(x / y) for x, y in zip(p, q, strict=True))


def test_stability_of_numbers(spark):
    draw = np.random.default_rng(3)
    old, new = draw.normal(0, 1, 900).round(2), draw.normal(0.5, 1, 500).round(2)
    few_old, few_new = draw.integers(0, 4, 900).astype(float), draw.integers(1, 6, 500).astype(float)
    data = [(False, float(a), float(b), 1.0, None) for a, b in zip(old, few_old, strict=True)] + [(True, float(a), float(b), 1.0, 2.0) for a, b in zip(new, few_new, strict=True)]
    df = spark.createDataFrame(data, "recent boolean, x double, few double, one double, late double")
    got = {r.feature: (r.n_bins, r.psi) for r in orders.stability(df, F.col("recent"), ["x", "few", "one", "late"]).collect()}
    assert set(got) == {"x", "few", "one"}
    for name, a, b in (("x", old, new), ("few", few_old, few_new), ("one", np.ones(900), np.ones(500))):
        n, psi = index(a, b)
        assert got[name][0] == n and abs(got[name][1] - psi) < 1e-9


def test_request_report(spark):
    at = lambda h: datetime.datetime(2026, 1, 1, h, 30)
    log = spark.createDataFrame([(1, at(1), "a", 5.0), (2, at(1), "b", 15.0), (3, at(2), "a", 19.0), (4, at(2), None, None)], "request_id int, at timestamp_ntz, endpoint string, latency double")
    got = {(r.section, r.label): (r.n, r.latency) for r in orders.request_report(log, newest=2).collect()}
    assert got[("total", None)] == (4, 13.0) and got[("endpoint", "a")] == (2, 12.0) and got[("endpoint", None)] == (1, None)
    assert got[("hour", "2026-01-01 02:00")] == (2, 19.0) and got[("latency", "10")] == (2, 17.0)
    assert {k: v for k, v in got.items() if k[0] == "newest"} == {("newest", "4"): (1, None), ("newest", "3"): (2, 19.0)}


def test_discoveries(spark):
    stored = [("a", 5.0, 0.9, 1, 0), ("a", 5.0, 0.001, 2, 1), ("b", -2.0, 0.02, 1, 2), ("b", -2.0, 0.03, 1, 3), ("c", 1.0, 0.04, 1, 4), ("d", 1.0, 0.5, 1, 5), ("flat", 1e-12, 0.0, 1, 6), ("nan", math.nan, 0.01, 1, 7), ("inf", math.inf, 0.01, 1, 8), ("null", None, 0.01, 1, 9), ("nop", 3.0, None, 1, 10)]
    df = spark.createDataFrame([(k, e, p, 10, 20, t, i) for k, e, p, t, i in stored], "commodity string, effect double, p_value double, n_left int, n_right int, computed_at int, id int")
    found = discoveries.entries(df)
    got = {r.commodity: r for r in found.collect()}
    assert set(got) == {"a", "b", "c", "d", "flat", "nan", "inf", "null"}
    for k, q in {"a": 0.004, "b": 4 / 75, "c": 4 / 75, "d": 0.5}.items():
        assert abs(got[k].q_value - q) < 1e-12 and got[k].significant_fdr == (q < 0.05)
    assert got["c"].significant_raw and not got["d"].significant_raw
    assert all(got[k].degenerate and got[k].q_value is None for k in ("flat", "nan", "inf", "null"))
    (s,) = discoveries.summary(found).collect()
    assert tuple(s) == (4, 3, 1, 4, 0.2, "flat, inf, nan, null", "a")
    (none,) = discoveries.summary(discoveries.entries(df.limit(0))).collect()
    assert tuple(none) == (0, 0, 0, 0, 0.0, "", "")

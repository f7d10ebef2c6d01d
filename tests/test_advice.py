"""Advice on rows whose action is known, and over the tables."""

from graintide.plans import advice

SF = "/root/testdata/sf0.001"
SHAPE = "commodity string, district string, rdd_effect double, fe_effect double, risk_score double, current_price double, forecast_price double"


def _one(spark, *row, **more):
    return advice.advice(spark.createDataFrame([row], SHAPE), **more).first()


def test_actions_by_level_and_direction(spark):
    for risk, level, up, down in ((70.0, "HIGH", "LOCK_PROCUREMENT", "MONITOR"), (69.9, "MODERATE", "CONSIDER_EARLY_PROCUREMENT", "WATCH"), (40.0, "MODERATE", "CONSIDER_EARLY_PROCUREMENT", "WATCH"), (39.9, "LOW", "NO_ACTION_NEEDED", "NO_ACTION_NEEDED")):
        for effect, action in ((-3.0, up), (3.0, down), (0.0, down), (None, down)):
            found = _one(spark, "c", "d", effect, None, risk, None, None)
            assert (found.level, found.action) == (level, action)
        assert _one(spark, "c", "d", 3.0, None, risk, None, None, corrected=False).action == up


def test_evidence_and_text(spark):
    found = _one(spark, "onion", "d", -12.0, 4.0, 80.0, 100.0, 120.0)
    assert (found.evidence, found.confidence, round(found.trend_pct)) == (4, "high", 20)
    assert found.text == "HIGH risk (80%) for onion in d. Prices rise by 12 where rain crosses into deficit, which fixed effects confirm. The forecast is up: 120 after 100 (+20%). Lock in purchases before the expected rise."
    other = _one(spark, "onion", None, 12.0, 4.0, None, 0.0, 5.0)
    assert (other.evidence, other.confidence, other.trend_pct, other.action) == (2, "moderate", None, "WATCH")
    assert "in the region." in other.text and "fall by 12" in other.text and "don't confirm" in other.text and "forecast" not in other.text
    none = _one(spark, None, None, None, None, None, None, None)
    assert (none.evidence, none.confidence, none.level) == (0, "low", "MODERATE") and none.text == "MODERATE risk (50%) for the commodity in the region. Look again next week."
    assert "level" in _one(spark, "c", "d", None, None, 1.0, 100.0, 105.0).text and "down" in _one(spark, "c", "d", None, None, 1.0, 100.0, 90.0).text


def test_advice_of_the_tables(spark):
    found = advice.district_advice(spark, SF).toPandas()
    assert len(found) and found.text.notna().all() and not found.duplicated(["commodity", "state", "district"]).any()
    assert set(found.action) <= {a for a, _ in advice.ACTIONS.values()}
    assert (found.evidence >= found.risk_score.notna()).all() and (found.forecast_price.notna()).any()

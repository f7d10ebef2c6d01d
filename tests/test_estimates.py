"""Known values behind the estimators' texts."""

import duckdb
import pytest

from graintide.plans.estimators import PANEL, p_value, tables


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (1.96, 100000, 0.05), (2.576, 100000, 0.01), (2.086, 20, 0.05), (2.776, 4, 0.05), (2.447, 6, 0.05), (0.0, 8, 1.0)])
def test_p_value_matches_the_tables_of_t(t, df, p):
    assert duckdb.connect().execute(f"SELECT {p_value(f'{t}e0', f'{df}e0')}").fetchone()[0] == pytest.approx(p, abs=0.001)


@pytest.mark.parametrize("order", [1, 2])
def test_jump_is_found_by_both_orders(spark, order):
    """y = 1200 - 4x + 250 at and above the cutoff, without noise: the jump comes back."""
    points = "SELECT 'a' AS commodity, 'price' AS label, CAST(id AS DOUBLE) - 80 AS x, 1200 - 4 * (CAST(id AS DOUBLE) - 80) + CASE WHEN id - 80 >= -19 THEN 250 ELSE 0 END AS y, CAST(-19 AS DOUBLE) AS c FROM range(141)"
    rows = spark.sql(f"WITH {tables([20, 30], ['triangular', 'uniform'], (order,), points)} SELECT effect FROM fit").collect()
    assert len(rows) == 4 and all(row.effect == pytest.approx(250, abs=1e-6) for row in rows)


def test_no_estimate_from_an_empty_or_constant_panel(spark):
    """No points, or points all at one x: no row, no error."""
    for source in ("FROM range(0)", "FROM range(30)"):
        points = f"SELECT 'a' AS commodity, 'price' AS label, 1e0 AS x, 2e0 AS y, CAST(-19 AS DOUBLE) AS c {source}"
        assert spark.sql(f"WITH {tables([20], ['uniform'], (1,), points)} SELECT * FROM fit").count() == 0
    assert "panel" in PANEL

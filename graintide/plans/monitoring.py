"""Audits, baselines and drift shares over the price panel and retail orders."""

from __future__ import annotations

from graintide.plans.relational import _register, pearson, r, whole

#: One row a numeric column of the retail orders.
FEATURES = ("sales", "profit", "quantity", "discount")
_FEATURES = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, order_date FROM sales" for c in FEATURES)
_OLD = "order_date < DATE '2000-01-01'"

SQL = {
    "zscore_drift": f"WITH f AS ({_FEATURES}), b AS (SELECT feature, AVG(x) AS mean, STDDEV_SAMP(x) AS sd FROM f WHERE {_OLD} GROUP BY 1), z AS (SELECT f.feature, AVG(CASE WHEN ABS(f.x - b.mean) > 3 * b.sd THEN 1e0 ELSE 0e0 END) AS share, COUNT(*) AS n FROM f JOIN b ON b.feature = f.feature WHERE NOT f.{_OLD} AND b.sd > 0 GROUP BY 1) SELECT feature, n, {r('share', 6)} AS share, share > 0.1e0 AS drifted FROM z",
    "max_drawdown": f"WITH p AS (SELECT *, MAX(price) OVER (PARTITION BY commodity ORDER BY arrival_date ROWS UNBOUNDED PRECEDING) AS peak FROM daily WHERE price > 0) SELECT commodity, COUNT(*) AS n, {r('MIN(price / peak - 1) * 100')} AS max_drawdown_pct FROM p GROUP BY 1 HAVING COUNT(*) >= 10",
    "deficit_price_correlation": f"WITH f AS (SELECT sub_division, AVG(CASE WHEN departure_pct < -19 THEN 1e0 ELSE 0e0 END) AS freq FROM rainfall GROUP BY 1), p AS (SELECT commodity, state, district, AVG(modal_price) AS price FROM prices GROUP BY 1, 2, 3) SELECT p.commodity, COUNT(*) AS n_districts, {r('CORR(f.freq, p.price)', 6)} AS pearson_r FROM p JOIN district_map d ON d.state = p.state AND d.district = p.district JOIN f ON f.sub_division = d.sub_division GROUP BY 1 HAVING COUNT(*) >= 8",
}

for _key, _sql in SQL.items():
    _register(_key, whole(pearson(_sql, "CORR", "f.freq", "p.price", 6)), whole(_sql))

"""Reports over the price panel and retail orders: scans, joins, aggregates, windows, rankings.

Every text runs on Spark over the role views; DOUBLE results are rounded half up at
four places, written the same way for the oracle.
"""

from __future__ import annotations

from graintide import registry, views


def r(x: str, places: int = 4) -> str:
    """Half up with a hair's bias, so that sums taken in another order don't fall on either side of a tie."""
    k = 10**places
    return f"floor(CAST({x} AS DOUBLE) * {k} + 0.50001) / {k}"


def pearson(sql: str, corr: str, x: str, y: str, places: int = 4) -> str:
    """The text for Spark, whose CORR divides by zero where a column is constant: there NaN, as in the oracle, else by sums over the same pairs."""
    sxx, syy = f"regr_sxx({x}, {y})", f"regr_syy({x}, {y})"
    own = r(f"regr_sxy({x}, {y}) / (sqrt({sxx}) * sqrt({syy}))", places)
    return sql.replace(r(f"{corr}({x}, {y})", places), f"CASE WHEN {sxx} = 0 OR {syy} = 0 THEN CAST('NaN' AS DOUBLE) ELSE {own} END")


def whole(sql: str) -> str:
    """Cast the sums of ones and counts to BIGINT, which engines type differently."""
    out, at = [], 0
    while (i := sql.find("SUM(", at)) >= 0:
        depth, j = 1, i + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[i + 4 : j - 1]
        counts = inner == "n" or (inner.startswith("CASE") and inner.endswith("THEN 1 ELSE 0 END"))
        out += [sql[at:i], f"CAST({sql[i:j]} AS BIGINT)" if counts and not sql[j:].startswith(" OVER") else sql[i:j]]
        at = j
    return "".join([*out, sql[at:]])


TODAY = "DATE '2001-06-30'"
DUE = f"(SELECT *, arrival_date > {TODAY} AS is_future FROM prices)"

SQL = {
    # scans
    "scan_prices": f"SELECT state, district, market, commodity, arrival_date, {r('modal_price')} AS modal_price FROM prices WHERE state = 'ASIA' ORDER BY arrival_date DESC, modal_price DESC, src_order, src_line, src_part LIMIT 500",
    "newest_prices": f"SELECT commodity, market, arrival_date, {r('modal_price')} AS modal_price FROM prices ORDER BY arrival_date DESC, modal_price DESC, src_order, src_line, src_part LIMIT 100",
    # cleaning
    "date_quality": f"SELECT COUNT(*) AS n_rows, MIN(arrival_date) AS min_date, MAX(arrival_date) AS max_date, SUM(CASE WHEN arrival_date IS NULL THEN 1 ELSE 0 END) AS null_dates, SUM(CASE WHEN arrival_date > {TODAY} THEN 1 ELSE 0 END) AS future_dates FROM prices",
    "rescale_departure": f"SELECT t.sub_division, t.year, t.month, {r('CASE WHEN m.most < 1 THEN t.ratio * 100 ELSE t.ratio END')} AS departure_pct, {r('CASE WHEN m.most / 100 < 1 THEN t.ratio ELSE t.ratio / 100 END')} AS smaller FROM (SELECT sub_division, year, month, departure_pct / 100 AS ratio FROM rainfall) t CROSS JOIN (SELECT MAX(ABS(departure_pct)) / 100 AS most FROM rainfall) m",
    "cyclic_month": f"SELECT DISTINCT month, {r('sin(2 * pi() * month / 12)')} AS month_sin, {r('cos(2 * pi() * month / 12)')} AS month_cos FROM rainfall",
    "retail_clean": f"SELECT region, COUNT(*) AS n, {r('SUM(sales)')} AS sales, {r('SUM(profit)')} AS profit FROM sales GROUP BY 1",
    "discount_bands": f"SELECT CASE WHEN discount <= 0 THEN 0 WHEN discount <= 0.2 THEN 1 WHEN discount <= 0.4 THEN 2 ELSE 3 END AS band, COUNT(*) AS n, {r('SUM(profit) / SUM(sales)')} AS margin FROM sales GROUP BY 1",
    # maintenance
    "find_duplicate_keys": "SELECT market, commodity, variety, grade, arrival_date, COUNT(*) AS n FROM prices WHERE variety IS NOT NULL AND grade IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) > 1",
    "dedupe_keep_lowest_id": f"SELECT commodity, COUNT(*) AS n, {r('SUM(modal_price)')} AS total FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY market, commodity, variety, grade, arrival_date ORDER BY src_order, src_line, src_part, modal_price) AS seen FROM prices) t WHERE seen = 1 GROUP BY 1",
    "latest_per_key": f"SELECT commodity, arrival_date, market, {r('modal_price')} AS modal_price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date DESC, modal_price DESC, src_order, src_line, src_part) AS seen FROM prices) t WHERE seen = 1",
    "latest_row_per_district": f"SELECT commodity, state, district, year, month, {r('avg_price')} AS avg_price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity, state, district ORDER BY year DESC, month DESC) AS seen FROM monthly) t WHERE seen = 1",
    "upsert_prices": "WITH old AS (SELECT DISTINCT market, commodity, variety, grade, arrival_date FROM prices WHERE src_order % 2 = 0), new AS (SELECT DISTINCT market, commodity, variety, grade, arrival_date FROM prices WHERE src_order % 3 = 0) SELECT n.commodity, COUNT(*) AS inserted FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.market = n.market AND o.commodity = n.commodity AND o.arrival_date = n.arrival_date AND o.variety IS NOT DISTINCT FROM n.variety AND o.grade IS NOT DISTINCT FROM n.grade) GROUP BY 1",
    # joins
    "join_price_rain": f"SELECT commodity, sub_division, COUNT(*) AS n, {r('AVG(avg_price)')} AS avg_price, {r('AVG(departure_pct)')} AS departure FROM panel GROUP BY 1, 2",
    "panel_join": f"SELECT commodity, state, district, year, month, n, {r('avg_price')} AS avg_price, {r('departure_pct')} AS departure_pct FROM panel WHERE n >= 3",
    "climatology_join": f"WITH clim AS (SELECT sub_division, month, AVG(departure_pct) AS dep FROM rainfall GROUP BY 1, 2) SELECT m.commodity, d.sub_division, m.month, COUNT(*) AS n, {r('AVG(c.dep)')} AS dep FROM monthly m JOIN district_map d ON d.state = m.state AND d.district = m.district JOIN clim c ON c.sub_division = d.sub_division AND c.month = m.month GROUP BY 1, 2, 3",
    "fanout_month_join": f"SELECT n.commodity, n.month, COUNT(*) AS n, {r('SUM(n.avg_price) / COUNT(*)')} AS avg_price, {r('AVG(r.departure_pct)')} AS dep FROM national n LEFT JOIN rainfall r ON r.month = n.month GROUP BY 1, 2",
    "join_to_group_summary": f"WITH g AS (SELECT category, AVG(profit_margin) AS margin FROM sales GROUP BY 1) SELECT s.category, s.sub_category, COUNT(*) AS n, {r('AVG(s.profit_margin) - MIN(g.margin)')} AS against_category FROM sales s JOIN g ON g.category = s.category GROUP BY 1, 2",
    "left_deficit_freq": f"WITH f AS (SELECT sub_division, AVG(CASE WHEN departure_pct < -19 THEN 1e0 ELSE 0e0 END) AS freq FROM rainfall GROUP BY 1), p AS (SELECT commodity, state, district, AVG(modal_price) AS price FROM prices GROUP BY 1, 2, 3) SELECT p.commodity, COUNT(*) AS n, {r('corr(p.price, f.freq)')} AS pearson FROM p LEFT JOIN district_map d ON d.state = p.state AND d.district = p.district LEFT JOIN f ON f.sub_division = d.sub_division WHERE f.freq IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 8",
    "anti_new_keys": "WITH old AS (SELECT DISTINCT market, grade FROM prices WHERE src_order % 97 = 0) SELECT DISTINCT p.market, p.grade FROM prices p WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.market = p.market AND o.grade IS NOT DISTINCT FROM p.grade)",
    # aggregates
    "monthly_avg_prices": f"SELECT commodity, state, district, year, month, n, {r('avg_price')} AS avg_price FROM monthly WHERE n >= 3",
    "national_monthly_avg": f"SELECT commodity, year, month, n, {r('avg_price')} AS avg_price FROM national",
    "daily_avg_prices": f"SELECT commodity, arrival_date, n, {r('price')} AS price FROM daily",
    "monthly_price_series": f"SELECT commodity, year, month, n, {r('avg_price')} AS avg_price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY year DESC, month DESC) AS back FROM national) t WHERE back <= 48",
    "daily_trend_band": f"SELECT commodity, arrival_date, {r('AVG(modal_price)')} AS mean_price, {r('MIN(modal_price)')} AS low, {r('MAX(modal_price)')} AS high FROM prices GROUP BY 1, 2",
    "monthly_volatility": f"WITH m AS (SELECT commodity, state, district, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month, AVG(modal_price) AS avg_price, MAX(modal_price) - MIN(modal_price) AS spread, COUNT(*) AS trading_days FROM prices WHERE modal_price IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) >= 5) SELECT commodity, state, district, year, month, trading_days, {r('avg_price')} AS avg_price, {r('spread')} AS price_spread, {r('spread / NULLIF(avg_price, 0) * 100')} AS volatility_pct, {r('AVG(avg_price) OVER (PARTITION BY commodity, state ORDER BY year, month, district ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS prior_avg FROM m",
    "deficiency_ranking": f"WITH d AS (SELECT commodity, state, district, COUNT(*) AS months, SUM(CASE WHEN departure_pct < -19 THEN 1 ELSE 0 END) AS deficient, AVG(CASE WHEN departure_pct < -19 THEN avg_price END) AS price_deficient, AVG(CASE WHEN departure_pct >= -19 THEN avg_price END) AS price_normal FROM panel GROUP BY 1, 2, 3 HAVING COUNT(*) >= 6) SELECT commodity, state, district, months, deficient, {r('deficient * 100e0 / months')} AS deficient_pct, {r('price_deficient')} AS price_deficient, {r('price_normal')} AS price_normal, RANK() OVER (PARTITION BY commodity ORDER BY deficient DESC) AS deficiency_rank FROM d",
    "price_dispersion": f"WITH d AS (SELECT commodity, market, AVG(modal_price) AS avg_price, STDDEV_SAMP(modal_price) AS sd, MAX(modal_price) - MIN(modal_price) AS spread, COUNT(*) AS n FROM prices GROUP BY 1, 2 HAVING COUNT(*) >= 10) SELECT commodity, market, n, {r('avg_price')} AS avg_price, {r('sd')} AS sd, {r('spread')} AS spread, {r('sd / avg_price * 100')} AS dispersion_pct, RANK() OVER (PARTITION BY commodity ORDER BY {r('sd', 6)} DESC) AS dispersion_rank FROM d",
    "running_monthly_sales": f"WITH m AS (SELECT year(order_date) AS y, month(order_date) AS m, SUM(sales) AS sales, SUM(profit) AS profit FROM sales GROUP BY 1, 2), l AS (SELECT *, LAG(sales, 12) OVER (ORDER BY y, m) AS before, SUM(sales) OVER (ORDER BY y, m ROWS UNBOUNDED PRECEDING) AS running FROM m) SELECT y, m, {r('sales')} AS sales, {r('running')} AS running, {r('(sales - before) / before * 100')} AS yoy_pct, CASE WHEN (sales - before) / before > 0.1 THEN 'Growth' WHEN (sales - before) / before > -0.1 THEN 'Stable' ELSE 'Sharp Decline' END AS trend FROM l",
    "category_profitability": f"WITH s AS (SELECT category, sub_category, SUM(profit) AS profit, SUM(sales) AS sales, COUNT(*) AS n FROM sales GROUP BY 1, 2), c AS (SELECT category, SUM(profit) AS profit FROM s GROUP BY 1) SELECT s.category, s.sub_category, s.n, {r('s.profit')} AS profit, {r('c.profit')} AS category_profit, ROW_NUMBER() OVER (PARTITION BY s.category ORDER BY s.profit) AS worst FROM s JOIN c ON c.category = s.category",
    "segment_analysis": f"WITH t AS (SELECT segment, region, COUNT(*) AS n, SUM(profit) AS profit, AVG(profit_margin) AS margin FROM sales GROUP BY 1, 2) SELECT segment, region, n, {r('profit')} AS profit, RANK() OVER (ORDER BY {r('profit')} DESC) AS profit_rank, RANK() OVER (PARTITION BY segment ORDER BY {r('margin', 6)} DESC) AS margin_rank FROM t",
    "freshness_by_commodity": "WITH g AS (SELECT lower(commodity) AS commodity, state, district, MAX(arrival_date) AS newest, MIN(arrival_date) AS oldest, COUNT(*) AS n FROM prices GROUP BY 1, 2, 3) SELECT commodity, MAX(newest) AS latest_date, MIN(oldest) AS earliest_date, SUM(n) AS row_count, COUNT(DISTINCT district) AS n_districts, COUNT(DISTINCT state) AS n_states FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200",
    "warehouse_counts": "WITH g AS (SELECT commodity, state, district, COUNT(*) AS n FROM prices GROUP BY 1, 2, 3), p AS (SELECT SUM(n) AS n_prices, COUNT(DISTINCT commodity) AS n_commodities, COUNT(DISTINCT state) AS n_states, COUNT(DISTINCT district) AS n_districts FROM g), r AS (SELECT COUNT(*) AS n_rain, SUM(CASE WHEN departure_pct BETWEEN -100 AND 200 THEN 1 ELSE 0 END) AS in_band, SUM(CASE WHEN departure_pct < -19 THEN 1 ELSE 0 END) AS deficient FROM rainfall) SELECT * FROM p CROSS JOIN r",
    "avg_price_and_districts": f"SELECT commodity, {r('AVG(modal_price)')} AS avg_price, COUNT(DISTINCT district) AS n_districts FROM prices GROUP BY 1",
    "deficit_exposure": f"WITH y AS (SELECT year, COUNT(*) AS n, SUM(CASE WHEN departure_pct < -19 THEN 1 ELSE 0 END) AS low FROM rainfall GROUP BY 1) SELECT year, n, {r('low * 1e0 / n')} AS share, {r('SUM(low) OVER () * 1e0 / SUM(n) OVER ()')} AS overall_share, {r('AVG(low * 1e0 / n) OVER ()')} AS long_run_mean FROM y",
    "risk_ledger": f"WITH d AS (SELECT sub_division, AVG(departure_pct) AS dep FROM rainfall GROUP BY 1), p AS (SELECT commodity, state, district, AVG(modal_price) AS price FROM prices GROUP BY 1, 2, 3) SELECT p.commodity, p.state, p.district, {r('p.price')} AS price, CASE WHEN d.dep IS NULL THEN 'No Data' WHEN -d.dep >= 19 THEN 'High' WHEN -d.dep >= 10 THEN 'Medium' ELSE 'Low' END AS tier FROM p LEFT JOIN district_map m ON m.state = p.state AND m.district = p.district LEFT JOIN d ON d.sub_division = m.sub_division",
    "monsoon_baseline": f"WITH y AS (SELECT year, SUM(rainfall_mm) AS mm FROM rainfall WHERE month BETWEEN 6 AND 9 GROUP BY 1) SELECT {r('AVG(mm)')} AS mean_mm, {r('0.81 * AVG(mm)')} AS deficit_line, MIN_BY(year, mm) AS driest, MAX_BY(year, mm) AS wettest, MAX(year) AS last_year, {r('MAX_BY(mm, year)')} AS last_mm FROM y",
    "rain_climatology_daily": f"SELECT sub_division, year, month, {r('rainfall_mm')} AS mm, {r('normal_mm')} AS normal, {r('departure_pct')} AS departure FROM rainfall",
    "worst_subcategories": f"SELECT sub_category, COUNT(DISTINCT order_id) AS n_orders, {r('AVG(is_loss * 1e0)')} AS loss_rate FROM sales GROUP BY 1 HAVING COUNT(DISTINCT order_id) >= 20 ORDER BY 3 DESC, 1 LIMIT 10",
    "daily_median_price": f"SELECT commodity, arrival_date, {r('MEDIAN(modal_price)')} AS price FROM prices WHERE modal_price > 0 GROUP BY 1, 2",
    "retail_drilldown": f"SELECT {r('SUM(sales)')} AS sales, {r('SUM(profit)')} AS profit, {r('AVG(profit_margin)')} AS margin, {r('AVG(is_loss * 100e0)')} AS loss_pct FROM sales WHERE region = 'ASIA' AND segment = 'BUILDING' AND year(order_date) = 1997",
    # windows
    "yoy_rainfall_season": f"WITH l AS (SELECT *, LAG(departure_pct, 12) OVER w AS dep_before, LAG(avg_price, 12) OVER w AS price_before FROM panel WINDOW w AS (PARTITION BY commodity, state, district ORDER BY year, month)) SELECT commodity, state, district, year, month, {r('avg_price - price_before')} AS price_change, CASE WHEN departure_pct < -19 AND dep_before >= -19 THEN 'Newly deficient' WHEN departure_pct >= -19 AND dep_before < -19 THEN 'Recovered' ELSE 'Stable' END AS season FROM l",
    "ranking_set": f"WITH g AS (SELECT commodity, state, COUNT(*) AS n FROM prices GROUP BY 1, 2) SELECT commodity, state, n, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY n DESC, state) AS rn, RANK() OVER (PARTITION BY commodity ORDER BY n DESC) AS rk, {r('n * 1e0 / SUM(n) OVER (PARTITION BY commodity)')} AS share FROM g",
    "lag_rolling_features": f"WITH f AS (SELECT commodity, state, district, year, month, LAG(departure_pct, 1) OVER w AS lag1, LAG(departure_pct, 2) OVER w AS lag2, LAG(departure_pct, 3) OVER w AS lag3, AVG(departure_pct) OVER v AS roll_mean, AVG(avg_price) OVER v AS price_mean, STDDEV_SAMP(avg_price) OVER v AS price_sd, STDDEV_SAMP(ln(avg_price)) OVER v AS log_sd, COUNT(*) OVER v AS held FROM panel WHERE avg_price > 0 WINDOW w AS (PARTITION BY commodity, state, district ORDER BY year, month), v AS (PARTITION BY commodity, state, district ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT commodity, state, district, year, month, {r('lag1')} AS lag1, {r('lag2')} AS lag2, {r('lag3')} AS lag3, {r('roll_mean')} AS roll_mean, CASE WHEN held >= 2 THEN {r('price_sd / NULLIF(price_mean, 0)')} END AS roll_volatility, CASE WHEN held >= 2 THEN {r('log_sd')} END AS roll_log_sd FROM f",
    "daily_diff_returns": f"SELECT commodity, arrival_date, {r('price / before - 1')} AS ret, {r('price - before')} AS diff FROM (SELECT *, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM daily) t WHERE before > 0",
    "monthly_close_returns": f"WITH m AS (SELECT commodity, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month, MAX_BY(price, arrival_date) AS price FROM daily WHERE price > 0 GROUP BY 1, 2, 3), b AS (SELECT *, LAG(price) OVER (PARTITION BY commodity ORDER BY year, month) AS before FROM m) SELECT commodity, year, month, {r('price')} AS month_end_price, {r('price / before - 1')} AS ret FROM b",
    "running_max_drawdown": f"WITH o AS (SELECT commodity, arrival_date, price, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date) - 1 AS pos FROM daily WHERE price > 0), p AS (SELECT *, MAX(price) OVER (PARTITION BY commodity ORDER BY arrival_date ROWS UNBOUNDED PRECEDING) AS peak FROM o), t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY price / peak, pos) AS place FROM p) SELECT t.commodity, {r('(t.price / t.peak - 1) * 100')} AS max_drawdown_pct, t.arrival_date AS trough, t.pos AS trough_index, MIN(p.pos) AS peak_index, MIN(p.arrival_date) AS peak_date FROM t JOIN p ON p.commodity = t.commodity AND p.pos <= t.pos AND p.price = t.peak WHERE t.place = 1 GROUP BY t.commodity, t.price, t.peak, t.arrival_date, t.pos",
    "ecdf_two_sample": f"WITH h AS (SELECT commodity, price, CASE WHEN back <= 90 THEN 1 ELSE 0 END AS recent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date DESC) AS back FROM daily) t), c AS (SELECT commodity, SUM(recent) OVER w * 1e0 / SUM(recent) OVER (PARTITION BY commodity) AS f1, SUM(1 - recent) OVER w * 1e0 / SUM(1 - recent) OVER (PARTITION BY commodity) AS f2 FROM h WINDOW w AS (PARTITION BY commodity ORDER BY price RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT commodity, {r('MAX(ABS(f1 - f2))')} AS ks_d FROM c GROUP BY 1",
    "repeat_share": f"SELECT commodity, COUNT(*) AS n, {r('AVG(CASE WHEN price = before THEN 1e0 ELSE 0e0 END)')} AS share FROM (SELECT *, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM daily) t GROUP BY 1",
    # top-k and sets
    "price_movers": f"WITH last AS (SELECT commodity, MAX(arrival_date) AS day FROM prices WHERE modal_price > 0 GROUP BY 1), d AS (SELECT p.commodity, l.day, p.district, MAX(p.modal_price) AS price FROM prices p JOIN last l ON l.commodity = p.commodity AND l.day = p.arrival_date WHERE p.modal_price > 0 GROUP BY 1, 2, 3), m AS (SELECT commodity, COUNT(*) AS n_districts, MEDIAN(price) AS mid, MAX(price) - MIN(price) AS spread FROM d GROUP BY 1), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY price, district) AS low, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY price DESC, district) AS high FROM d) SELECT k.commodity, k.day, k.district, {r('k.price')} AS price, k.low, k.high, m.n_districts, {r('m.mid')} AS median_price, {r('m.spread')} AS spread FROM k JOIN m ON m.commodity = k.commodity WHERE k.low <= 5 OR k.high <= 5",
    "custom_order": "SELECT discount_tier, COUNT(*) AS n, CASE discount_tier WHEN 'No Discount' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS place FROM sales GROUP BY 1, 3 ORDER BY 3 NULLS LAST",
    "last_n_rows": f"SELECT commodity, arrival_date, {r('price')} AS price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date DESC) AS back FROM daily) t WHERE back <= 90",
    "representative_district": "SELECT sub_division, state, district FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sub_division ORDER BY state, district) AS k FROM district_map) t WHERE k = 1",
    "priority_merge": "WITH u AS (SELECT district, state, 2 AS prio FROM district_map UNION ALL SELECT district, concat('archive ', state) AS state, 1 AS prio FROM district_map WHERE district < 'J') SELECT district, state FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY prio DESC, state) AS k FROM u) t WHERE k = 1",
    # risk, drift, freshness
    "var_cvar": f"WITH l AS (SELECT commodity, -(price / before - 1) AS loss FROM (SELECT *, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM daily) t WHERE before > 0), v AS (SELECT commodity, PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY loss) AS var95 FROM l GROUP BY 1) SELECT l.commodity, COUNT(*) AS n, {r('MIN(v.var95)')} AS var95, {r('AVG(CASE WHEN l.loss >= v.var95 THEN l.loss END)')} AS cvar95 FROM l JOIN v ON v.commodity = l.commodity GROUP BY 1 HAVING COUNT(*) >= 30",
    "annualised_volatility": f"SELECT commodity, {r('STDDEV_POP(price / before - 1) * sqrt(252) * 100')} AS vol FROM (SELECT *, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM daily) t WHERE before > 0 GROUP BY 1",
    "monthly_rise_frequency": f"SELECT commodity, COUNT(*) AS months, {r('AVG(CASE WHEN avg_price / before - 1 > 0.1 THEN 1e0 ELSE 0e0 END)')} AS share FROM (SELECT *, LAG(avg_price) OVER (PARTITION BY commodity ORDER BY year, month) AS before FROM national) t WHERE before > 0 GROUP BY 1 HAVING COUNT(*) >= 12",
    "upstream_lag_signature": "WITH f AS (SELECT commodity, MAX(arrival_date) AS latest FROM prices GROUP BY 1) SELECT COUNT(*) AS n, COUNT(DISTINCT latest) AS n_dates, CASE WHEN COUNT(DISTINCT latest) = 1 THEN 'upstream lag' ELSE 'ingest behind' END AS verdict FROM f",
    "health_status": f"SELECT CASE WHEN COUNT(*) = 0 THEN 'empty' WHEN SUM(CASE WHEN arrival_date > {TODAY} THEN 1 ELSE 0 END) > 0 THEN 'degraded' WHEN MAX(arrival_date) IS NULL THEN 'unknown' WHEN MAX(arrival_date) < {TODAY} - INTERVAL '3' DAY THEN 'stale' ELSE 'healthy' END AS status FROM prices",
}


def _register(key: str, sql: str, oracle: str | None = None, kept: tuple[str, ...] = ()) -> None:
    """Put one text under a key; ``oracle`` is its DuckDB spelling where the two engines differ, ``kept`` the views to compute once."""
    registry.texts[key] = (sql, kept)
    registry.register(key, views.cte(oracle or sql))(lambda spark, sf_dir: views.run(spark, sf_dir, sql, kept))


for _key, _sql in SQL.items():
    _register(_key, whole(pearson(_sql, "corr", "p.price", "f.freq")), whole(_sql))

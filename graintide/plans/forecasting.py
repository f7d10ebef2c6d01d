"""Forecasts, intervals, drift, tails and recommendations over the daily and monthly price series."""

from __future__ import annotations

from graintide.plans.estimators import ONE
from graintide.plans.relational import _register, r, whole

BACK = "SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date DESC) AS back, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date) AS pos, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM daily"
TRAIN = "days AS (SELECT commodity, CAST(year(arrival_date) AS INT) AS y, CAST(month(arrival_date) AS INT) AS m, AVG(price) AS price, COUNT(*) AS n_days FROM daily GROUP BY 1, 2, 3), series AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY y DESC, m DESC) AS back, COUNT(*) OVER (PARTITION BY commodity) AS months, SUM(n_days) OVER (PARTITION BY commodity) AS all_days FROM days), split AS (SELECT *, CASE WHEN months > 6 AND back <= 3 THEN 'test' ELSE 'train' END AS part FROM series WHERE months >= 6 AND all_days >= 20)"
#: Persistence from the last training month, the same month a year before, and a straight line over the training months.
MODELS = f"{TRAIN}, last AS (SELECT commodity, MAX_BY(price, -back) AS price FROM split WHERE part = 'train' GROUP BY 1), trend AS (SELECT commodity, REGR_SLOPE(price, -back) AS b, REGR_INTERCEPT(price, -back) AS a FROM split WHERE part = 'train' GROUP BY 1), guess AS (SELECT t.commodity, t.y, t.m, t.price, 'persistence' AS model, l.price AS yhat FROM split t JOIN last l ON l.commodity = t.commodity WHERE t.part = 'test' UNION ALL SELECT t.commodity, t.y, t.m, t.price, 'seasonal' AS model, o.price AS yhat FROM split t JOIN split o ON o.commodity = t.commodity AND o.y = t.y - 1 AND o.m = t.m AND o.part = 'train' WHERE t.part = 'test' UNION ALL SELECT t.commodity, t.y, t.m, t.price, 'trend' AS model, g.a - g.b * t.back AS yhat FROM split t JOIN trend g ON g.commodity = t.commodity WHERE t.part = 'test')"
SCORES = f"{MODELS}, scores AS (SELECT commodity, model, COUNT(*) AS n, AVG(ABS(price - yhat)) AS mae, SQRT(AVG((price - yhat) * (price - yhat))) AS rmse, AVG(ABS(price - yhat) / price) * 100 AS mape FROM guess WHERE price > 0 GROUP BY 1, 2)"
LOSSES = f"ret AS (SELECT commodity, -(price / before - 1) AS loss FROM ({BACK}) t WHERE before > 0 AND price > 0 AND back <= 730)"
#: Peaks over the 90 % quantile; probability-weighted moments give shape and scale in closed form.
PWM = f"{LOSSES}, thr AS (SELECT commodity, COUNT(*) AS n, percentile_cont(0.9) WITHIN GROUP (ORDER BY loss) AS u FROM ret GROUP BY 1), exc AS (SELECT r.commodity, r.loss - t.u AS x, t.u, t.n, ROW_NUMBER() OVER (PARTITION BY r.commodity ORDER BY r.loss) AS i, COUNT(*) OVER (PARTITION BY r.commodity) AS k FROM ret r JOIN thr t ON t.commodity = r.commodity WHERE r.loss > t.u), wm AS (SELECT commodity, MIN(u) AS u, MIN(n) AS n, MIN(k) AS k, AVG(x) AS b0, SUM((k - i) * x) / MIN(k * (k - 1e0)) AS a1 FROM exc WHERE k >= 25 GROUP BY 1), gpd AS (SELECT *, 2 - b0 / (b0 - 2 * a1) AS xi, 2 * b0 * a1 / (b0 - 2 * a1) AS sigma FROM wm WHERE n >= 60 AND b0 > 2 * a1)"
_EDGES = ", ".join(f"percentile_cont({k / 10}) WITHIN GROUP (ORDER BY price) AS e{k}" for k in range(1, 10))
_BIN = " + ".join(f"CASE WHEN s.price >= e.e{k} THEN 1 ELSE 0 END" for k in range(1, 10))
#: Deciles of the older days; equal edges give empty bins on both sides, which add nothing.
PSI = f"split AS (SELECT commodity, price, CASE WHEN back <= 90 THEN 1 ELSE 0 END AS recent FROM ({BACK}) t), e AS (SELECT commodity, MIN(price) AS lo, MAX(price) AS hi, {_EDGES} FROM split WHERE recent = 0 GROUP BY 1), b AS (SELECT s.commodity, s.recent, {_BIN} AS bin, s.price BETWEEN e.lo AND e.hi AS inside FROM split s JOIN e ON e.commodity = s.commodity), tot AS (SELECT commodity, SUM(recent) * 1e0 AS n1, SUM(1 - recent) * 1e0 AS n0 FROM b GROUP BY 1), c AS (SELECT commodity, bin, SUM(CASE WHEN recent = 1 THEN 1 ELSE 0 END) AS k1, SUM(CASE WHEN recent = 0 THEN 1 ELSE 0 END) AS k0 FROM b WHERE inside GROUP BY 1, 2), parts AS (SELECT c.commodity, GREATEST(k1 / n1, 1e-6) AS p1, GREATEST(k0 / n0, 1e-6) AS p0 FROM c JOIN tot ON tot.commodity = c.commodity WHERE n1 >= 20 AND n0 >= 20), psi AS (SELECT commodity, SUM((p1 - p0) * ln(p1 / p0)) AS psi FROM parts GROUP BY 1)"
_SER = " + ".join(f"({'' if k % 2 else '-'}2e0) * exp(-2e0 * {k * k} * lam * lam)" for k in range(1, 11))
KS = f"two AS (SELECT commodity, price, CASE WHEN back <= 90 THEN 1 ELSE 0 END AS recent FROM ({BACK}) t), cum AS (SELECT commodity, SUM(recent) OVER w AS c1, SUM(1 - recent) OVER w AS c0, SUM(recent) OVER (PARTITION BY commodity) * 1e0 AS n1, SUM(1 - recent) OVER (PARTITION BY commodity) * 1e0 AS n0 FROM two WINDOW w AS (PARTITION BY commodity ORDER BY price RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ks AS (SELECT commodity, MAX(ABS(c1 / n1 - c0 / n0)) AS d, MIN(SQRT(n1 * n0 / (n1 + n0))) AS root FROM cum WHERE n1 >= 20 AND n0 >= 20 GROUP BY 1), ksp AS (SELECT *, (root + 0.12e0 + 0.11e0 / root) * d AS lam FROM ks), ksq AS (SELECT commodity, d, CASE WHEN lam < 0.3 THEN 1e0 ELSE LEAST(1e0, GREATEST(0e0, {_SER})) END AS p FROM ksp)"
#: Exponentially weighted mean in closed form over at most 48 standardised months.
EWMA = "w48 AS (SELECT commodity, avg_price, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY year DESC, month DESC) AS back FROM national), zs AS (SELECT commodity, back, (avg_price - AVG(avg_price) OVER (PARTITION BY commodity)) / NULLIF(STDDEV_POP(avg_price) OVER (PARTITION BY commodity), 0) AS z, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY back DESC) AS t FROM w48 WHERE back <= 48), ew AS (SELECT commodity, t, power(0.8e0, t) * SUM(0.2e0 * z * power(0.8e0, -t)) OVER (PARTITION BY commodity ORDER BY t ROWS UNBOUNDED PRECEDING) AS ewma FROM zs)"
QUALITY = f"win AS (SELECT * FROM ({BACK}) t WHERE back <= 120), pr AS (SELECT commodity, arrival_date, price, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS before FROM win), md AS (SELECT commodity, MEDIAN(price) AS mid FROM pr GROUP BY 1), ma AS (SELECT p.commodity, MIN(m.mid) AS mid, MEDIAN(ABS(p.price - m.mid)) AS mad FROM pr p JOIN md m ON m.commodity = p.commodity GROUP BY 1), q AS (SELECT p.commodity, COUNT(*) AS n, GREATEST(MAX(p.arrival_date) - MIN(p.arrival_date), 1) AS span, DATE '2001-11-04' - MAX(p.arrival_date) AS stale, COALESCE(AVG(CASE WHEN p.before IS NULL THEN NULL WHEN p.price = p.before THEN 1e0 ELSE 0e0 END), 0) AS repeats, AVG(CASE WHEN a.mad > 0 AND ABS(p.price - a.mid) / (1.4826e0 * a.mad) > 3.5 THEN 1e0 ELSE 0e0 END) AS outliers FROM pr p JOIN ma a ON a.commodity = p.commodity GROUP BY 1), quality AS (SELECT commodity, n, span, stale, repeats, outliers, 100 * (0.5e0 * LEAST(1e0, n * 1e0 / span) + 0.2e0 * GREATEST(0e0, 1 - GREATEST(stale, 0) / 30e0) + 0.2e0 * (1 - repeats) + 0.1e0 * (1 - outliers)) AS score FROM q)".replace("MAX(p.arrival_date) - MIN(p.arrival_date)", "datediff_days(MIN(p.arrival_date), MAX(p.arrival_date))").replace("DATE '2001-11-04' - MAX(p.arrival_date)", "datediff_days(MAX(p.arrival_date), DATE '2001-11-04')")
NDVI = "ndvi AS (SELECT state, district, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month, AVG(max_price / modal_price - 1) * 10 AS ndvi FROM prices GROUP BY 1, 2, 3, 4)"
CATEGORICAL = "mix AS (SELECT sub_category, SUM(CASE WHEN order_date < DATE '2000-01-01' THEN 1 ELSE 0 END) AS k0, SUM(CASE WHEN order_date >= DATE '2000-01-01' THEN 1 ELSE 0 END) AS k1 FROM sales GROUP BY 1), sh AS (SELECT sub_category, GREATEST(k0 * 1e0 / NULLIF(SUM(k0) OVER (), 0), 0.001e0) AS p0, GREATEST(k1 * 1e0 / NULLIF(SUM(k1) OVER (), 0), 0.001e0) AS p1 FROM mix)"
#: The newest absolute persistence residuals (30 % of them), their order statistic at the corrected level.
CONFORMAL = f"res AS (SELECT commodity, ABS(price - before) AS e, price, before, back, COUNT(*) OVER (PARTITION BY commodity) AS n FROM ({BACK}) t WHERE before IS NOT NULL), cal AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY e) AS i, COUNT(*) OVER (PARTITION BY commodity) AS m FROM res WHERE n >= 10 AND back <= GREATEST(CASE WHEN (n * 3) % 10 = 5 THEN 2 * floor((n * 3 + 5) / 20e0) ELSE floor((n * 3 + 5) / 10e0) END, 1)), half AS (SELECT commodity, MIN(e) AS half_width, MIN(m) AS m FROM cal WHERE i = ceil((m - 1) * LEAST(1e0, ceil((m + 1) * 0.9e0) / m)) + 1 GROUP BY 1)"

SQL = {
    "monthly_training_series": f"WITH {TRAIN} SELECT commodity, y, m, n_days, {r('price')} AS price, part FROM split",
    "naive_and_lag_forecast": f"WITH {MODELS} SELECT commodity, y, m, model, {r('price')} AS price, {r('yhat')} AS yhat FROM guess",
    "forecast_vs_actual_join": f"WITH {MODELS} SELECT t.commodity, t.y, t.m, {r('t.price')} AS actual, COUNT(g.model) AS n_models, {r('AVG(g.yhat)')} AS mean_yhat FROM split t LEFT JOIN guess g ON g.commodity = t.commodity AND g.y = t.y AND g.m = t.m WHERE t.part = 'test' GROUP BY t.commodity, t.y, t.m, t.price",
    "forecast_metrics": f"WITH {SCORES} SELECT commodity, model, n, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mape')} AS mape FROM scores",
    "compare_models": f"WITH {SCORES}, best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY {r('mape', 6)}, model) AS place, LEAD({r('mape', 6)}) OVER (PARTITION BY commodity ORDER BY {r('mape', 6)}, model) AS runner_up FROM scores) SELECT commodity, model AS winner, {r('mape')} AS mape, {r('runner_up - mape')} AS lead_pct, CASE WHEN runner_up IS NULL THEN 'only model' WHEN runner_up - mape < 0.0001 THEN 'tie' ELSE 'best' END AS reason FROM best WHERE place = 1",
    "volatility_envelope": f"WITH med AS (SELECT commodity, arrival_date, MEDIAN(modal_price) AS price, STDDEV_POP(modal_price) AS across FROM prices WHERE modal_price > 0 GROUP BY 1, 2), d AS (SELECT *, price - LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS step, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY arrival_date DESC) AS back FROM med), s AS (SELECT commodity, MAX(CASE WHEN back = 1 THEN price END) AS latest, AVG(step) AS drift, GREATEST(STDDEV_SAMP(step), 0.15e0 * COALESCE(MAX(CASE WHEN back = 1 THEN across END), 0), 1e0) AS sd FROM d GROUP BY 1), k AS ({' UNION ALL '.join(f'SELECT {k} AS ahead' for k in range(1, 15))}) SELECT commodity, ahead, {r('latest + drift * ahead')} AS centre, {r('GREATEST(1e0, latest + drift * ahead - 1.96e0 * sd * SQRT(ahead * 1e0))')} AS low, {r('latest + drift * ahead + 1.96e0 * sd * SQRT(ahead * 1e0)')} AS high FROM s CROSS JOIN k",
    "split_conformal": f"WITH {CONFORMAL} SELECT h.commodity, h.m AS n_calibration, {r('MIN(h.half_width)')} AS half_width, {r('AVG(CASE WHEN r.back > h.m THEN NULL WHEN r.e <= h.half_width THEN 1e0 ELSE 0e0 END)')} AS coverage, {r('MAX(CASE WHEN r.back = 1 THEN r.price - h.half_width END)')} AS low, {r('MAX(CASE WHEN r.back = 1 THEN r.price + h.half_width END)')} AS high FROM half h JOIN res r ON r.commodity = h.commodity GROUP BY 1, 2",
    "spike_features": f"WITH cutp AS (SELECT commodity, percentile_cont(0.75) WITHIN GROUP (ORDER BY avg_price) AS p75 FROM panel WHERE n >= 3 GROUP BY 1), f AS (SELECT *, LAG(departure_pct, 1) OVER w AS lag1, LAG(departure_pct, 2) OVER w AS lag2, LAG(departure_pct, 3) OVER w AS lag3, AVG(departure_pct) OVER v AS roll, AVG(avg_price) OVER v AS roll_price, STDDEV_SAMP(avg_price) OVER v / NULLIF(AVG(avg_price) OVER v, 0) AS volatility FROM panel WHERE n >= 3 WINDOW w AS (PARTITION BY commodity, state, district ORDER BY year, month), v AS (PARTITION BY commodity, state, district ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT f.commodity, f.state, f.district, f.year, f.month, {r('lag1')} AS lag1, {r('lag2')} AS lag2, {r('lag3')} AS lag3, {r('roll')} AS roll, {r('roll_price')} AS roll_price, {r('volatility')} AS volatility, {r('sin(2 * pi() * f.month / 12)')} AS month_sin, {r('cos(2 * pi() * f.month / 12)')} AS month_cos, CASE WHEN f.avg_price >= c.p75 THEN 1 ELSE 0 END AS spike FROM f JOIN cutp c ON c.commodity = f.commodity",
    "gpd_tail_fit": f"WITH {PWM} SELECT commodity, n, k AS n_beyond, {r('u')} AS threshold, {r('xi')} AS shape, {r('sigma')} AS scale FROM gpd",
    "evt_var_es": f"WITH {PWM}, q AS (SELECT *, u + sigma / xi * (power(0.01e0 / (k * 1e0 / n), -xi) - 1) AS var99 FROM gpd WHERE ABS(xi) > 1e-6 AND xi < 1) SELECT commodity, {r('var99')} AS var99, {r('(var99 + sigma - xi * u) / (1 - xi)')} AS es99 FROM q",
    "tail_risk_report": f"WITH {PWM}, q AS (SELECT commodity, xi, u + sigma / xi * (power(0.01e0 / (k * 1e0 / n), -xi) - 1) AS evt99, sigma, u FROM gpd WHERE ABS(xi) > 1e-6 AND xi < 1), v AS (SELECT commodity, COUNT(*) AS n, percentile_cont(0.95) WITHIN GROUP (ORDER BY loss) AS v95, percentile_cont(0.99) WITHIN GROUP (ORDER BY loss) AS v99, STDDEV_POP(loss) AS sd FROM ret GROUP BY 1), c AS (SELECT v.commodity, AVG(CASE WHEN r.loss >= v.v95 - 1e-12 THEN r.loss END) AS c95, AVG(CASE WHEN r.loss >= v.v99 - 1e-12 THEN r.loss END) AS c99 FROM v JOIN ret r ON r.commodity = v.commodity GROUP BY 1), pk AS (SELECT commodity, price, MAX(price) OVER (PARTITION BY commodity ORDER BY arrival_date ROWS UNBOUNDED PRECEDING) AS peak FROM ({BACK}) t WHERE back <= 730 AND price > 0), dd AS (SELECT commodity, MIN(price / peak - 1) * 100 AS drawdown FROM pk GROUP BY 1), mm AS (SELECT commodity, avg_price, LAG(avg_price) OVER (PARTITION BY commodity ORDER BY year, month) AS before FROM national), ri AS (SELECT commodity, AVG(CASE WHEN avg_price / before - 1 > 0.1 THEN 1e0 ELSE 0e0 END) AS rises FROM mm WHERE before > 0 GROUP BY 1 HAVING COUNT(*) >= 12) SELECT v.commodity, v.n, {r('v.v95')} AS var95, {r('v.v99')} AS var99, {r('v.sd * sqrt(252e0) * 100')} AS volatility_pct, {r('c.c95')} AS cvar95, {r('c.c99')} AS cvar99, {r('q.evt99')} AS evt_var99, {r('(q.evt99 + q.sigma - q.xi * q.u) / (1 - q.xi)')} AS evt_es99, {r('dd.drawdown')} AS max_drawdown_pct, {r('ri.rises')} AS rise_share FROM v JOIN c ON c.commodity = v.commodity LEFT JOIN q ON q.commodity = v.commodity LEFT JOIN dd ON dd.commodity = v.commodity LEFT JOIN ri ON ri.commodity = v.commodity WHERE v.n >= 30",
    "psi": f"WITH {PSI} SELECT commodity, {r('psi')} AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'shifted' END AS verdict FROM psi",
    "psi_retail": f"WITH {CATEGORICAL} SELECT {r('SUM((p1 - p0) * ln(p1 / p0))')} AS psi, COUNT(*) AS n_values, SUM((p1 - p0) * ln(p1 / p0)) > 0.2e0 AS drifted FROM sh",
    "ks_two_sample": f"WITH {KS} SELECT commodity, {r('d')} AS ks_d, {r('p')} AS p_value, p < 0.05 AS drifted FROM ksq",
    "ewma_chart": f"WITH {EWMA} SELECT commodity, t, {r('ewma')} AS ewma, ABS(ewma) > 1.0000001e0 AS out_of_control FROM ew WHERE ewma IS NOT NULL",
    "data_quality_score": f"WITH {QUALITY} SELECT commodity, n, span AS span_days, stale AS stale_days, {r('repeats')} AS repeat_share, {r('outliers')} AS outlier_share, {r('score', 1)} AS score FROM quality",
    "drift_report": f"WITH {PSI}, {KS}, {EWMA}, {QUALITY} SELECT k.commodity, {r('p.psi')} AS psi, {r('k.d')} AS ks_d, {r('k.p')} AS ks_p, x.n_out, {r('q.score', 1)} AS quality_score FROM ksq k LEFT JOIN psi p ON p.commodity = k.commodity LEFT JOIN (SELECT commodity, SUM(CASE WHEN ABS(ewma) > 1.0000001e0 THEN 1 ELSE 0 END) AS n_out FROM ew GROUP BY 1) x ON x.commodity = k.commodity LEFT JOIN quality q ON q.commodity = k.commodity JOIN (SELECT commodity FROM daily GROUP BY 1 HAVING COUNT(*) >= 120) g ON g.commodity = k.commodity",
    "ndvi_summary": f"WITH {NDVI} SELECT district, COUNT(*) AS n, {r('AVG(ndvi)')} AS mean_ndvi, {r('MAX_BY(ndvi, year * 12 + month)')} AS latest, {r('MAX_BY(ndvi, year * 12 + month) - AVG(ndvi)')} AS anomaly FROM ndvi GROUP BY 1",
    "ndvi_rain_crosscheck": f"WITH {NDVI}, l AS (SELECT *, LAG(ndvi) OVER (PARTITION BY state, district ORDER BY year, month) AS before FROM ndvi) SELECT l.district, l.year, l.month, {r('l.ndvi - l.before')} AS change, CASE WHEN l.ndvi - l.before < -0.0001 AND r.departure_pct < -19 THEN 'drought' WHEN l.ndvi - l.before < -0.0001 THEN 'other' ELSE 'none' END AS cause FROM l JOIN district_map d ON d.state = l.state AND d.district = l.district JOIN rainfall r ON r.sub_division = d.sub_division AND r.year = l.year AND r.month = l.month WHERE l.before IS NOT NULL",
    "recommendation": f"WITH {ONE}, dis AS (SELECT commodity, COUNT(*) AS n, AVG(CASE WHEN departure_pct < -19 THEN 1e0 ELSE 0e0 END) * 100 AS risk FROM panel GROUP BY 1), m AS (SELECT commodity, REGR_SLOPE(avg_price, year * 12 + month) / AVG(avg_price) * 100 AS trend FROM national GROUP BY 1), e AS (SELECT d.commodity, d.risk, m.trend, f.effect, f.p, CASE WHEN f.p < 0.05 THEN 1 ELSE 0 END + CASE WHEN d.risk >= 40 THEN 1 ELSE 0 END + CASE WHEN m.trend > 0 THEN 1 ELSE 0 END AS evidence FROM dis d LEFT JOIN m ON m.commodity = d.commodity LEFT JOIN fit f ON f.commodity = d.commodity) SELECT commodity, {r('risk')} AS risk, {r('trend')} AS trend_pct, {r('effect')} AS effect, evidence, CASE WHEN evidence >= 3 THEN 'high' WHEN evidence = 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN risk >= 70 AND evidence >= 2 THEN 'LOCK' WHEN risk >= 70 THEN 'CONSIDER' WHEN risk >= 40 THEN 'MONITOR' WHEN evidence > 0 THEN 'WATCH' ELSE 'NONE' END AS action FROM e",
}
#: Days from the first date to the second, as each engine writes it.
SPARK_DAYS, DUCK_DAYS = "datediff(DAY, ", "date_diff('day', "

for _key, _sql in SQL.items():
    _register(_key, whole(_sql.replace("datediff_days(", SPARK_DAYS)), whole(_sql.replace("datediff_days(", DUCK_DAYS)))

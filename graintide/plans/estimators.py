"""Regression discontinuity on all commodities at once, by moment sums.

Each side of a cutoff is a weighted polynomial (order 0 to 2) in u = (x - c) / h;
sums per (commodity, label, specification, side) give the coefficients in closed
form, a second pass the HC2 variance.  The specification grid is a few broadcast
rows.  A side whose normal equations are close to singular gives no estimate.
"""

from __future__ import annotations

from graintide.plans.relational import _register, r, whole

CUTOFF = -19.0
WEIGHT = "CASE kernel WHEN 'triangular' THEN 1 - ABS(u) WHEN 'uniform' THEN 1.0 ELSE 0.75 * (1 - u * u) END"
KEY = "commodity, label, bw, kernel, poly"
#: Points are rows of (commodity, label, x, y, c); the plain ones are the panel's at the fixed cutoff.
PANEL = f"SELECT commodity, 'price' AS label, departure_pct AS x, avg_price AS y, CAST({CUTOFF} AS DOUBLE) AS c FROM panel"


def p_value(t: str, df: str) -> str:
    """Two-sided p of Student's t: Wallace's normal transform, then a five-term erfc (within 0.001 of tabled values at 4 to 20 df)."""
    x = f"((8e0 * ({df}) + 1) / (8e0 * ({df}) + 3) * SQRT(({df}) * ln(1 + ({t}) * ({t}) / ({df}))) / SQRT(2e0))"
    k = f"(1 / (1 + 0.3275911e0 * {x}))"
    return f"({k} * (0.254829592e0 + {k} * (-0.284496736e0 + {k} * (1.421413741e0 + {k} * (-1.453152027e0 + {k} * 1.061405429e0)))) * exp(-{x} * {x}))"


def tables(bandwidths: list[int], kernels: list[str], orders: tuple[int, ...] = (1,), points: str = PANEL, pre: str = "") -> str:
    """Common tables whose last, ``{pre}fit``, has effect, SE, t, p and counts by commodity, label and specification."""
    grid = " UNION ALL ".join(f"SELECT {b} AS bw, '{k}' AS kernel, {o} AS poly" for b in bandwidths for k in kernels for o in orders)
    return f"""{pre}grid AS ({grid}),
{pre}xy AS ({points}),
{pre}h AS (SELECT commodity, label, (MAX(x) - MIN(x)) / 100.0 AS one FROM {pre}xy GROUP BY 1, 2),
{pre}near AS (SELECT commodity, label, bw, kernel, poly, CASE WHEN x < c THEN 0 ELSE 1 END AS side, y, (x - c) / (bw * one) AS u
 FROM {pre}xy JOIN {pre}h USING (commodity, label) CROSS JOIN {pre}grid WHERE one > 0 AND ABS(x - c) <= bw * one),
{pre}wt AS (SELECT *, {WEIGHT} AS w FROM {pre}near),
{pre}mom AS (SELECT {KEY}, side, COUNT(*) AS n, SUM(w) AS s0, SUM(w * u) AS s1, SUM(w * u * u) AS s2, SUM(w * u * u * u) AS s3, SUM(w * u * u * u * u) AS s4,
 SUM(w * y) AS t0, SUM(w * u * y) AS t1, SUM(w * u * u * y) AS t2 FROM {pre}wt GROUP BY {KEY}, side HAVING COUNT(*) >= 5),
{pre}cof AS (SELECT *, CASE poly WHEN 0 THEN 1e0 WHEN 1 THEN s2 ELSE s2 * s4 - s3 * s3 END AS ca,
 CASE poly WHEN 0 THEN 0e0 WHEN 1 THEN -s1 ELSE s2 * s3 - s1 * s4 END AS cb, CASE WHEN poly = 2 THEN s1 * s3 - s2 * s2 ELSE 0e0 END AS cc,
 CASE poly WHEN 0 THEN 0e0 WHEN 1 THEN s0 ELSE s0 * s4 - s2 * s2 END AS cd, CASE WHEN poly = 2 THEN s1 * s2 - s0 * s3 ELSE 0e0 END AS ce,
 CASE WHEN poly = 2 THEN s0 * s2 - s1 * s1 ELSE 0e0 END AS cf FROM {pre}mom),
{pre}line AS (SELECT *, s0 * ca + s1 * cb + s2 * cc AS det FROM {pre}cof WHERE s0 * ca + s1 * cb + s2 * cc > 1e-6 * power(s0, poly + 1)),
{pre}coef AS (SELECT {KEY}, side, n, s0, det, ca, cb, cc, cd, ce, cf, (ca * t0 + cb * t1 + cc * t2) / det AS a, (cb * t0 + cd * t1 + ce * t2) / det AS b, (cc * t0 + ce * t1 + cf * t2) / det AS g FROM {pre}line),
{pre}var AS (SELECT {KEY}, side, MIN(n) AS n, MIN(a) AS a, SUM(power(w * (ca + cb * u + cc * u * u) / det, 2) * power(y - a - b * u - g * u * u, 2)
 / (1 - LEAST(0.99e0, GREATEST(0e0, w * (ca + 2 * cb * u + (2 * cc + cd) * u * u + 2 * ce * u * u * u + cf * u * u * u * u) / det)))) AS v
 FROM {pre}wt JOIN {pre}coef USING (commodity, label, bw, kernel, poly, side) GROUP BY {KEY}, side),
{pre}pair AS (SELECT {KEY}, MAX(CASE WHEN side = 1 THEN a END) - MAX(CASE WHEN side = 0 THEN a END) AS effect, SQRT(SUM(v)) AS se,
 MAX(CASE WHEN side = 0 THEN n END) AS n_left, MAX(CASE WHEN side = 1 THEN n END) AS n_right FROM {pre}var GROUP BY {KEY} HAVING COUNT(*) = 2),
{pre}tee AS (SELECT *, effect / NULLIF(se, 0) AS t, n_left + n_right - 2 * (poly + 1) AS df FROM {pre}pair),
{pre}fit AS (SELECT *, CASE WHEN df > 0 THEN {p_value('t', 'df')} END AS p FROM {pre}tee)"""


ROW = f"commodity, bw, kernel, n_left, n_right, {r('effect')} AS effect, {r('-effect')} AS deficit_effect, {r('se')} AS std_error, {r('t')} AS t_stat, {r('p')} AS p_value"
KERNELS = ["triangular", "uniform", "epanechnikov"]
WIDTHS = [10, 15, 20, 25, 30]
ONE = tables([20], ["triangular"])
CURVE = tables(WIDTHS, KERNELS, (1, 2))

PLACEBO = " UNION ALL ".join(
    f"SELECT commodity, 'p{k}' AS label, floor(percentile_cont({k / 100}) WITHIN GROUP (ORDER BY departure_pct) * 100 + 0.5) / 100 AS c FROM panel GROUP BY 1" for k in (20, 40, 50, 60, 80)
)
PLACEBO_POINTS = f"SELECT p.commodity, k.label, p.departure_pct AS x, p.avg_price AS y, k.c FROM panel p JOIN cuts k ON k.commodity = p.commodity WHERE ABS(k.c - ({CUTOFF})) > 2"
BALANCE_POINTS = (
    f"SELECT commodity, 'n_observations' AS label, departure_pct AS x, CAST(n AS DOUBLE) AS y, CAST({CUTOFF} AS DOUBLE) AS c FROM panel"
    f" UNION ALL SELECT commodity, 'log_n' AS label, departure_pct AS x, ln(n + 1) AS y, CAST({CUTOFF} AS DOUBLE) AS c FROM panel"
)
#: Twenty equal bins of the running variable, with the count of each; widths are shares of the span of the bin centres.
BINS = """span AS (SELECT commodity, MIN(departure_pct) AS lo, (MAX(departure_pct) - MIN(departure_pct)) / 20e0 AS wide FROM panel GROUP BY 1),
hist AS (SELECT p.commodity, CAST(LEAST(19, floor((p.departure_pct - s.lo) / s.wide)) AS INT) AS k, COUNT(*) AS n FROM panel p JOIN span s ON s.commodity = p.commodity WHERE s.wide > 0 GROUP BY 1, 2),
""" + f"slots AS ({' UNION ALL '.join(f'SELECT {k} AS k' for k in range(20))})," + """
density AS (SELECT s.commodity, b.k, s.lo + (b.k + 0.5e0) * s.wide AS x, COALESCE(h.n, 0) AS n FROM span s CROSS JOIN slots b LEFT JOIN hist h ON h.commodity = s.commodity AND h.k = b.k)"""
DENSITY_POINTS = f"SELECT commodity, 'density' AS label, x, ln(n + 1) AS y, CAST({CUTOFF} AS DOUBLE) AS c FROM density"

ROBUST = f"""WITH cuts AS ({PLACEBO}), {BINS}, {tables(WIDTHS, ['triangular'], pre='w_')}, {tables([20], ['triangular'], points=PLACEBO_POINTS, pre='p_')},
{tables([50], ['triangular'], points=DENSITY_POINTS, pre='d_')}, {tables([20], ['triangular'], points=BALANCE_POINTS, pre='b_')},
turns AS (SELECT *, CASE WHEN effect > 0 THEN 1 ELSE -1 END <> LAG(CASE WHEN effect > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY commodity ORDER BY bw) AS turned FROM w_fit),
w AS (SELECT commodity, COUNT(*) AS n_valid, SUM(CASE WHEN turned THEN 1 ELSE 0 END) AS sign_changes, MIN(p) AS best_p FROM turns GROUP BY 1),
pl AS (SELECT commodity, COUNT(*) AS n_placebo, AVG(CASE WHEN p < 0.05 THEN 1e0 ELSE 0e0 END) AS share FROM p_fit GROUP BY 1),
de AS (SELECT commodity, MIN(p) AS density_p FROM d_fit GROUP BY 1),
ba AS (SELECT commodity, MIN(p) * COUNT(*) AS balance_p FROM b_fit GROUP BY 1),
marks AS (SELECT w.commodity, n_valid, sign_changes, n_placebo, CASE WHEN n_valid >= 3 AND sign_changes <= 1 AND best_p < 0.1 THEN 1 ELSE 0 END AS bandwidth_ok,
 CASE WHEN COALESCE(share, 0) < 0.5 THEN 1 ELSE 0 END AS placebo_ok, CASE WHEN density_p IS NULL OR density_p > 0.05 THEN 1 ELSE 0 END AS density_ok,
 CASE WHEN balance_p IS NULL OR balance_p > 0.05 THEN 1 ELSE 0 END AS balance_ok FROM w LEFT JOIN pl ON pl.commodity = w.commodity LEFT JOIN de ON de.commodity = w.commodity LEFT JOIN ba ON ba.commodity = w.commodity)
SELECT *, bandwidth_ok + placebo_ok + density_ok + balance_ok AS passed, bandwidth_ok + placebo_ok + density_ok + balance_ok >= 3 AS robust FROM marks"""

#: Benjamini and Hochberg: the running minimum, from the largest p down, of p times n over rank.
QVALUES = """ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, commodity, bw, kernel) AS place, COUNT(*) OVER () AS tests FROM usable),
adjusted AS (SELECT *, LEAST(1e0, MIN(p * tests / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked)"""

SQL = {
    "kernel_weights": f"WITH g AS (SELECT 'triangular' AS kernel UNION ALL SELECT 'uniform' AS kernel UNION ALL SELECT 'epanechnikov' AS kernel), x AS (SELECT DISTINCT {r('departure_pct / 100', 3)} AS u FROM rainfall) SELECT kernel, u, {r(f'CASE WHEN ABS(u) > 1 THEN 0.0 ELSE {WEIGHT} END')} AS weight FROM x CROSS JOIN g",
    "rdd_local_linear": f"WITH {ONE} SELECT {ROW} FROM fit",
    "rdd_local_poly": f"WITH {tables([20, 30], KERNELS, (0, 1, 2))} SELECT poly, {ROW} FROM fit",
    "rdd_bandwidth_sensitivity": f"WITH {tables(WIDTHS, ['triangular'])} SELECT {ROW} FROM fit",
    "spec_curve": f"WITH {CURVE} SELECT poly, {ROW} FROM fit",
    "spec_curve_summary": f"WITH {CURVE}, s AS (SELECT commodity, COUNT(*) AS n_estimated, SUM(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) AS n_significant, MEDIAN(effect) AS median_effect, AVG(effect) AS mean_effect, MIN(effect) AS min_effect, MAX(effect) AS max_effect, percentile_cont(0.75) WITHIN GROUP (ORDER BY effect) - percentile_cont(0.25) WITHIN GROUP (ORDER BY effect) AS iqr, AVG(CASE WHEN effect > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM fit GROUP BY 1) SELECT commodity, n_estimated, n_significant, {r('median_effect')} AS median_effect, {r('mean_effect')} AS mean_effect, {r('min_effect')} AS min_effect, {r('max_effect')} AS max_effect, {r('iqr')} AS iqr, {r('positive')} AS share_positive, positive IN (0e0, 1e0) AS sign_stable, {r('n_estimated * 0.05e0')} AS expected_false_positives FROM s",
    "rdd_placebo": f"WITH cuts AS ({PLACEBO}), {tables([20], ['triangular'], points=PLACEBO_POINTS)} SELECT label, {ROW} FROM fit",
    "covariate_balance": f"WITH {tables([20], ['triangular'], points=BALANCE_POINTS)} SELECT label, {ROW} FROM fit",
    "mccrary_density": f"WITH {BINS}, {tables([20, 50], ['triangular'], points=DENSITY_POINTS)} SELECT {ROW}, CASE WHEN p < 0.05 THEN 'sorting suspected' ELSE 'continuous' END AS verdict FROM fit",
    "density_bins": f"WITH {BINS} SELECT commodity, k, {r('x')} AS centre, n FROM density",
    "rdd_plot_bins": f"WITH h AS (SELECT commodity, (MAX(departure_pct) - MIN(departure_pct)) * 0.3e0 AS reach FROM panel GROUP BY 1), b AS (SELECT p.commodity, p.avg_price AS y, p.departure_pct AS x, CAST(LEAST(14, floor((p.departure_pct - ({CUTOFF}) + h.reach) / (2 * h.reach) * 15)) AS INT) AS bin FROM panel p JOIN h ON h.commodity = p.commodity WHERE h.reach > 0 AND ABS(p.departure_pct - ({CUTOFF})) <= h.reach) SELECT commodity, bin, COUNT(*) AS n, {r('AVG(x)')} AS mean_x, {r('AVG(y)')} AS mean_y, {r('STDDEV_POP(y)')} AS sd_y FROM b GROUP BY 1, 2",
    "rdd_plot_lines": f"WITH h AS (SELECT commodity, (MAX(departure_pct) - MIN(departure_pct)) * 0.3e0 AS reach FROM panel GROUP BY 1), b AS (SELECT p.commodity, CASE WHEN p.departure_pct < {CUTOFF} THEN 'deficit' ELSE 'normal' END AS side, p.avg_price AS y, p.departure_pct - ({CUTOFF}) AS x FROM panel p JOIN h ON h.commodity = p.commodity WHERE ABS(p.departure_pct - ({CUTOFF})) <= h.reach) SELECT commodity, side, COUNT(*) AS n, {r('REGR_SLOPE(y, x)')} AS slope, {r('REGR_INTERCEPT(y, x)')} AS at_cutoff FROM b GROUP BY 1, 2 HAVING COUNT(*) >= 5",
    "robustness_report": ROBUST,
    "bh_qvalues": f"WITH {CURVE}, usable AS (SELECT commodity, bw, concat(kernel, CAST(poly AS VARCHAR(2))) AS kernel, p FROM fit WHERE p IS NOT NULL), {QVALUES} SELECT commodity, bw, kernel, {r('p')} AS p_value, {r('q')} AS q_value FROM adjusted",
    "fdr_report": f"WITH {ONE}, usable AS (SELECT * FROM fit WHERE p IS NOT NULL AND ABS(effect) >= 1e-6), {QVALUES} SELECT commodity, {r('effect')} AS effect, {r('p')} AS p_value, {r('q')} AS q_value, q < 0.05 AS survives FROM adjusted",
    "static_gate": f"WITH {ONE} SELECT commodity, n_left + n_right AS matched, {r('p')} AS p_value, CASE WHEN n_left + n_right >= 20 AND p < 0.1 THEN 'go' ELSE 'no-go' END AS gate FROM fit",
    "rdd_report": f"WITH {ONE}, n AS (SELECT commodity, COUNT(*) AS n_panel, SUM(CASE WHEN departure_pct < {CUTOFF} THEN 1 ELSE 0 END) AS n_deficit FROM panel GROUP BY 1) SELECT n.commodity, n_panel, n_deficit, n_left, n_right, {r('effect')} AS effect, {r('p')} AS p_value, CASE WHEN p IS NULL THEN 'no estimate' WHEN p < 0.05 THEN 'significant' WHEN p < 0.1 THEN 'suggestive' ELSE 'no effect found' END AS reading FROM n LEFT JOIN fit ON fit.commodity = n.commodity",
}

for _key, _sql in SQL.items():
    _register(_key, whole(_sql), kept=("panel",))

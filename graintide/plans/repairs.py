"""Cleaning, merges, freshness lists and retail reports by functions of DataFrames, each with its own DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import catalog, cleaning, discoveries, orders, registry, views
from graintide.functions import text
from graintide.plans.estimators import tables
from graintide.plans.ingestion import DUCK_STATUS, SPARK_RAW, TODAY
from graintide.plans.relational import r

#: The day after the given tables' last rows.
NOW = "2001-11-05"
#: Names of the given tables' states in the shape of the alias list, beside it.
ALIASES = {**cleaning.STATE_ALIASES, "asia": "Asia", "middle east": "Middle East"}
_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())
_CANON = "COALESCE((SELECT name FROM (VALUES {rows}) AS a(alias, name) WHERE alias = lower(trim({c}))), {c})"
_SPELT = "CASE src_line WHEN 1 THEN ' Orissa' WHEN 2 THEN 'DELHI ' WHEN 3 THEN 'Andaman and Nicobar' ELSE state END"
_NUMBER = "CASE src_line WHEN 1 THEN 'na' WHEN 2 THEN ' NaN ' WHEN 3 THEN '-' WHEN 4 THEN 'null' WHEN 5 THEN '1,x' ELSE concat(' 1,', CAST(src_part AS VARCHAR(20)), '.5 ') END"
_MISSING = ", ".join(f"'{m}'" for m in text.MISSING)
_GAPS = "SELECT CASE WHEN src_line % 3 = 0 THEN '' WHEN src_line % 3 = 1 THEN NULL ELSE state END AS state, CASE WHEN src_line = 3 THEN concat(' ', lower(district)) ELSE district END AS district FROM prices"
_COORDS = "SELECT DISTINCT district, state FROM prices WHERE district < 'NATION_2'"
_ARCHIVE = "SELECT district, concat('Archive ', state) AS state FROM district_map WHERE state = 'ASIA'"
_MANUAL = "SELECT district, 'delhi' AS state FROM district_map WHERE district LIKE '%7'"
_TITLE = "array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_PLACES = "SELECT CASE WHEN sub_division = 'SUBDIV_3' THEN {s} ELSE state END AS state, CASE WHEN sub_division = 'SUBDIV_3' THEN {d} ELSE district END AS district, sub_division FROM district_map"
_TARGETS = ("STANDARD", "ECONOMY", "no such thing", "PROMO", "STANDARD")
_TARGET_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(dict.fromkeys(_TARGETS)))


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return views.run(spark, sf_dir, sql)


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.expr(r(c, places)) for c in columns})


@registry.register("date_parse_summary", views.cte(f"{DUCK_STATUS} SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'ok') AS ok, COUNT(*) FILTER (status = 'missing') AS missing, COUNT(*) FILTER (status = 'unparseable') AS unparseable, COUNT(*) FILTER (status = 'future') AS future, COUNT(*) FILTER (status = 'impossible') AS impossible, COUNT(*) FILTER (status <> 'ok') AS rejected, COUNT(*) FILTER (status = 'ok' AND day(day) <= 12 AND day(day) <> month(day)) AS ambiguous FROM s"))
def date_parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw date texts by status, with the rejected and the ambiguous ones."""
    return cleaning.date_summary(_run(spark, sf_dir, SPARK_RAW), "raw", F.lit(TODAY).cast("date"))


@registry.register("clean_numbers", views.cte(f"WITH t AS (SELECT commodity, {_NUMBER} AS raw FROM prices), v AS (SELECT commodity, CASE WHEN lower(trim(raw)) NOT IN ({_MISSING}) THEN TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS v FROM t) SELECT commodity, COUNT(*) AS n, COUNT(*) FILTER (v IS NULL) AS n_null, {r('SUM(v)')} AS total FROM v GROUP BY 1"))
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number texts with thousands commas, and those that mean none, summed by commodity."""
    rows = _run(spark, sf_dir, f"SELECT commodity, {_NUMBER} AS raw FROM prices").withColumn("v", text.clean_number(F.col("raw")))
    return _rounded(rows.groupBy("commodity").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.sum("v").alias("total")), "total")


@registry.register("canonical_state", views.cte(f"WITH t AS (SELECT {_SPELT} AS raw FROM prices), g AS (SELECT raw, COUNT(*) AS n FROM t GROUP BY 1), a AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) AS x(alias, name)) SELECT COALESCE(a.name, g.raw) AS state, CAST(SUM(g.n) AS BIGINT) AS n FROM g LEFT JOIN a ON a.alias = lower(trim(g.raw)) GROUP BY 1"))
def canonical_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the state that its spelling stands for."""
    rows = _run(spark, sf_dir, f"SELECT {_SPELT} AS state FROM prices")
    return rows.groupBy(cleaning.canonical_state(F.col("state"), ALIASES).alias("state")).agg(F.count("*").alias("n"))


_LOOKUP = f"u AS (SELECT district, state, 0 AS rank FROM ({_COORDS}) c UNION ALL SELECT district, state, 1 AS rank FROM ({_ARCHIVE}) c UNION ALL SELECT district, state, 2 AS rank FROM ({_MANUAL}) c), a AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) AS x(alias, name)), named AS (SELECT lower(trim(u.district)) AS place, u.rank, COALESCE(a.name, u.state) AS state FROM u LEFT JOIN a ON a.alias = lower(trim(u.state))), look AS (SELECT place, state FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY place ORDER BY rank DESC, state DESC) AS k FROM named) t WHERE k = 1), gaps AS ({_GAPS}), filled AS (SELECT CASE WHEN g.state <> '' THEN COALESCE(a.name, g.state) ELSE l.state END AS state, g.district, CASE WHEN g.state <> '' THEN 'own' WHEN l.state IS NOT NULL THEN 'lookup' ELSE 'nothing' END AS state_from FROM gaps g LEFT JOIN look l ON l.place = lower(trim(g.district)) LEFT JOIN a ON a.alias = lower(trim(g.state)))"


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [_run(spark, sf_dir, s) for s in (_COORDS, _ARCHIVE, _MANUAL)]
    return cleaning.backfill_states(_run(spark, sf_dir, _GAPS), cleaning.state_lookup(*sources, aliases=ALIASES), ALIASES)


@registry.register("state_backfill", views.cte(f"WITH {_LOOKUP} SELECT state, district, state_from, COUNT(*) AS n FROM filled GROUP BY 1, 2, 3"))
def state_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by state, district and where the state comes from: three lookups, the last of which stands first."""
    return _filled(spark, sf_dir).groupBy("state", "district", "state_from").agg(F.count("*").alias("n"))


@registry.register("state_backfill_report", views.cte(f"WITH {_LOOKUP} SELECT district, COUNT(*) AS n, bool_or(state_from = 'lookup') AS matched FROM filled WHERE state_from <> 'own' GROUP BY 1"))
def state_backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts whose rows had no state, and whether one was found."""
    return cleaning.backfill_report(_filled(spark, sf_dir))


@registry.register("district_to_subdivision", views.cte(f"WITH places AS ({_PLACES.format(s=_TITLE.format(c='state'), d=_TITLE.format(c='district'))}), g AS (SELECT state, district, COUNT(*) AS n FROM prices GROUP BY 1, 2) SELECT g.state, g.district, COALESCE(p.sub_division, t.sub_division) AS sub_division, g.n FROM g LEFT JOIN places p ON p.state = g.state AND p.district = g.district LEFT JOIN places t ON t.state = {_TITLE.format(c='g.state')} AND t.district = {_TITLE.format(c='g.district')}"))
def district_to_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by place and sub-division, by exact names, else by title case; places without one have null."""
    rows = _run(spark, sf_dir, "SELECT state, district, COUNT(*) AS n FROM prices GROUP BY 1, 2")
    places = _run(spark, sf_dir, _PLACES.format(s="initcap(state)", d="initcap(district)"))
    return cleaning.to_subdivision(rows, places, unmapped=True)


@registry.register("scan_rainfall", views.cte(f"SELECT sub_division, year, month, {r('departure_pct')} AS departure_pct FROM rainfall WHERE departure_pct BETWEEN -100 AND 200 AND lower(sub_division) = 'subdiv_3' ORDER BY year, month"))
def scan_rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of one sub-division, in order."""
    rows = _run(spark, sf_dir, "SELECT sub_division, year, month, departure_pct FROM rainfall")
    return _rounded(cleaning.rainfall_rows(rows, "subdiv_3"), "departure_pct")


@registry.register("insert_or_ignore", views.cte(f"WITH new AS (SELECT sub_division, year, month, rainfall_mm, 0 AS writer FROM rainfall WHERE year >= 1996 UNION ALL SELECT sub_division, year, month, rainfall_mm * 2 AS rainfall_mm, 1 AS writer FROM rainfall WHERE month < 7) SELECT sub_division, year, month, {r('rainfall_mm')} AS rainfall_mm, writer FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sub_division, year, month ORDER BY writer) AS k FROM new) t WHERE k = 1 AND NOT (year < 1997 AND sub_division <> 'SUBDIV_1')"))
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that two writers add to a table: those it holds are ignored, and of the two the first counts."""
    rows = _run(spark, sf_dir, "SELECT sub_division, year, month, rainfall_mm FROM rainfall")
    second = rows.filter("month < 7").withColumns({"rainfall_mm": F.col("rainfall_mm") * 2, "writer": F.lit(1)})
    new = rows.filter("year >= 1996").withColumn("writer", F.lit(0)).unionByName(second)
    old = rows.filter("year < 1997 AND sub_division <> 'SUBDIV_1'")
    return _rounded(catalog.insert_or_ignore(old, new, ["sub_division", "year", "month"], ["writer"]), "rainfall_mm")


@registry.register("replace_by_key_rows", views.cte(f"WITH new AS (SELECT commodity, arrival_date, price * 2 AS price, 1 AS gen FROM daily WHERE day(arrival_date) = 1 UNION ALL SELECT commodity, arrival_date, price * 3 AS price, 2 AS gen FROM daily WHERE day(arrival_date) = 1 AND month(arrival_date) = 1), u AS (SELECT commodity, arrival_date, price, 0 AS gen FROM daily UNION ALL SELECT * FROM new) SELECT commodity, arrival_date, {r('price')} AS price, gen FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity, arrival_date ORDER BY gen DESC) AS k FROM u) t WHERE k = 1"))
def replace_by_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices after two batches replaced the rows of their keys, the later batch last."""
    old = _run(spark, sf_dir, "SELECT commodity, arrival_date, price, 0 AS gen FROM daily")
    first = old.where(F.dayofmonth("arrival_date") == 1).withColumns({"price": F.col("price") * 2, "gen": F.lit(1)})
    second = first.where(F.month("arrival_date") == 1).withColumns({"price": F.col("price") * 1.5, "gen": F.lit(2)})
    return _rounded(catalog.replace_by_key(old, first.unionByName(second), ["commodity", "arrival_date"], ["gen"]), "price")


@registry.register("semi_catalog_filter", views.cte(f"WITH wanted AS (SELECT * FROM (VALUES {_TARGET_ROWS}) AS t(place, commodity)) SELECT w.place, w.commodity, COUNT(*) AS n FROM wanted w JOIN prices p ON p.commodity = w.commodity GROUP BY 1, 2"))
def semi_catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target commodities that the table holds, in the list's order, with their rows."""
    rows = catalog.rows_of_targets(_run(spark, sf_dir, "SELECT commodity FROM prices"), _TARGETS)
    counts = rows.groupBy("commodity").agg(F.count("*").alias("n"))
    return catalog.targets_present(_TARGETS, counts).join(counts, "commodity").select("place", "commodity", "n")


@registry.register("catalog_difference", views.cte("WITH w AS (SELECT lower(trim(district)) AS k, MIN(district) AS district FROM district_map WHERE state <> 'AFRICA' GROUP BY 1 UNION ALL SELECT 'atlantis' AS k, 'Atlantis' AS district), f AS (SELECT lower(trim(district)) AS k, MIN(district) AS district FROM prices GROUP BY 1) SELECT COALESCE(w.district, f.district) AS district, CASE WHEN f.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'unmatched' ELSE 'present' END AS place FROM w FULL JOIN f ON f.k = w.k"))
def catalog_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts wanted and found, wanted only, found only."""
    wanted = _run(spark, sf_dir, "SELECT district FROM district_map WHERE state <> 'AFRICA' UNION ALL SELECT 'Atlantis' AS district")
    return catalog.difference(wanted, _run(spark, sf_dir, "SELECT district FROM prices"), "district")


_SHAPES = {"daily": "SELECT commodity, arrival_date, price FROM daily", "monthly": "SELECT commodity, state, district, year, month, avg_price AS price FROM monthly", "rain": "SELECT sub_division, year, month, rainfall_mm FROM rainfall"}


@registry.register("union_sources", views.cte(f"SELECT 'daily' AS source, COUNT(*) AS n, COUNT(commodity) AS n_commodity, CAST(0 AS BIGINT) AS n_month, CAST(0 AS BIGINT) AS n_rain, {r('SUM(price)')} AS price FROM daily UNION ALL SELECT 'monthly', COUNT(*), COUNT(commodity), COUNT(month), 0, {r('SUM(avg_price)')} FROM monthly UNION ALL SELECT 'rain', COUNT(*), 0, COUNT(month), COUNT(rainfall_mm), NULL FROM rainfall"))
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of differing columns as one: cells that are filled, by source."""
    rows = catalog.union_sources(**{name: _run(spark, sf_dir, sql) for name, sql in _SHAPES.items()})
    return _rounded(rows.groupBy("source").agg(F.count("*").alias("n"), F.count("commodity").alias("n_commodity"), F.count("month").alias("n_month"), F.count("rainfall_mm").alias("n_rain"), F.sum("price").alias("price")), "price")


@registry.register("distinct_options", views.cte(" UNION ALL ".join(f"SELECT '{c}' AS field, row_number() OVER (ORDER BY n DESC, v) AS place, {_TITLE.format(c='v')} AS option, n FROM (SELECT {c} AS v, COUNT(*) AS n FROM prices WHERE {c} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}) t{i}" for i, (c, k) in enumerate((("district", 50), ("state", 50), ("market", 50), ("grade", 50), ("commodity", 12), ("variety", 50))))))
def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest values of each field in title case; twelve commodities, fifty of the others."""
    rows = _run(spark, sf_dir, "SELECT district, state, market, grade, commodity, variety FROM prices")
    parts = [catalog.options(rows, c, 12 if c == "commodity" else 50).select(F.lit(c).alias("field"), F.col("place").cast("long").alias("place"), "option", "n") for c in rows.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FRESH = "fresh AS (SELECT lower(trim(commodity)) AS commodity, MAX(arrival_date) AS latest, COUNT(*) AS n FROM prices GROUP BY 1)"
_WATCHED = tuple(dict.fromkeys(t.lower() for t in _TARGETS))
_WATCHED_ROWS = ", ".join(f"('{w}')" for w in _WATCHED)
_AGO = f"date_diff('hour', CAST(latest AS TIMESTAMP), TIMESTAMP '{NOW} 00:00:00') * 1e0"


@registry.register("stale_commodities", views.cte(f"WITH {_FRESH}, w AS (SELECT * FROM (VALUES {_WATCHED_ROWS}) AS x(commodity)), a AS (SELECT commodity, {_AGO} AS hours_ago FROM fresh), e AS (SELECT * FROM a WHERE hours_ago > 96 AND commodity NOT IN (SELECT commodity FROM w) ORDER BY hours_ago DESC, commodity LIMIT 5) SELECT w.commodity, 'watched' AS kind, CASE WHEN a.commodity IS NULL THEN 'missing' WHEN a.hours_ago <= 96 THEN 'fresh' ELSE 'stale' END AS state, a.hours_ago FROM w LEFT JOIN a ON a.commodity = w.commodity UNION ALL SELECT commodity, 'extra' AS kind, 'stale' AS state, hours_ago FROM e"))
def stale_commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched commodities, missing ones among them, and the five stalest others, at four days."""
    fresh = catalog.freshness(_run(spark, sf_dir, "SELECT commodity, arrival_date FROM prices"))
    return catalog.staleness(fresh, _TARGETS, F.lit(f"{NOW} 00:00:00").cast("timestamp"), hours=96)


@registry.register("freshness_kpis", views.cte(f"WITH f AS (SELECT commodity, CASE WHEN src_line = 1 THEN 'api' WHEN src_line < 4 THEN 'archive' ELSE '' END AS source_type, MAX(arrival_date) AS latest, COUNT(*) AS n FROM prices GROUP BY 1, 2) SELECT COUNT(DISTINCT commodity) AS commodities, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(DISTINCT CASE WHEN latest >= DATE '{NOW}' - INTERVAL '7' DAY THEN commodity END) AS recent, (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT source_type AS s FROM f WHERE source_type <> '') d) AS source_types FROM f"))
def freshness_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodities, rows, commodities of the last seven days, and source types of the freshness rows."""
    kinds = "CASE WHEN src_line = 1 THEN 'api' WHEN src_line < 4 THEN 'archive' ELSE '' END"
    fresh = _run(spark, sf_dir, f"SELECT commodity, {kinds} AS source_type, MAX(arrival_date) AS latest_date, COUNT(*) AS n FROM prices GROUP BY 1, 2")
    return catalog.freshness_kpis(fresh, F.lit(NOW).cast("date"))


_LINES = ("order_id", "line_no", "sales", "profit", "discount", "order_date", "ship_date")
_ORDERS = f"SELECT {', '.join(_LINES)} FROM sales"


@registry.register("retail_features", views.cte(f"SELECT order_id, line_no, {r('profit / sales * 100')} AS profit_margin, CASE WHEN discount = 0 THEN '0%' WHEN discount <= 0.2 THEN '1-20%' WHEN discount <= 0.4 THEN '21-40%' ELSE '41%+' END AS discount_tier, CAST(month(order_date) AS INT) AS order_month, CAST(year(order_date) AS INT) AS order_year, CAST(quarter(order_date) AS INT) AS order_quarter, strftime(order_date, '%b') AS order_month_name, strftime(order_date, '%Y-%m') AS order_year_month, is_loss, {r('ln(1 + sales)')} AS log_sales, CASE WHEN ship_date - order_date <= 2 THEN 'Fast' WHEN ship_date - order_date <= 5 THEN 'Normal' ELSE 'Slow' END AS shipping_delay_cat FROM sales"))
def retail_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its engineered columns."""
    rows = orders.features(_run(spark, sf_dir, _ORDERS)).drop("sales", "profit", "discount", "order_date", "ship_date")
    return _rounded(rows, "profit_margin", "log_sales")


_RAW = "SELECT order_id, product_name, quantity, sales, profit, CASE WHEN line_no % 5 = 0 THEN NULL ELSE segment END AS segment FROM sales_raw WHERE line_no <> 3 UNION ALL SELECT order_id, product_name, quantity, sales, profit, segment FROM sales_raw WHERE line_no = 1 AND order_id % 7 = 0"
_AUDITED = ("order_id", "product_name", "quantity", "sales", "profit", "segment")


@registry.register("retail_audit", views.cte(f"WITH t AS ({_RAW}) SELECT 'rows' AS measure, CAST(NULL AS VARCHAR) AS \"column\", COUNT(*) AS n FROM t UNION ALL SELECT 'losses', 'profit', COUNT(*) FILTER (profit < 0) FROM t UNION ALL " + " UNION ALL ".join(f"SELECT 'missing', '{c}', COUNT(*) FILTER ({c} IS NULL) FROM t" for c in _AUDITED) + " UNION ALL SELECT 'full duplicates', NULL, (SELECT COUNT(*) FROM t) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t) d) UNION ALL SELECT 'key duplicates', NULL, (SELECT COUNT(*) FROM t) - (SELECT COUNT(*) FROM (SELECT DISTINCT order_id, product_name FROM t) d)"))
def retail_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, losses, missing cells by column and duplicates of a raw order table with repeated lines."""
    return orders.audit(_run(spark, sf_dir, _RAW), ["order_id", "product_name"])


_CELLS = "COUNT(*) AS n, SUM(sales) AS sales, SUM(profit) AS profit, AVG(ship_date - order_date) AS delay_days FROM sales"
_DIMS = {**{d: d for d in orders.DIMENSIONS if d != "month"}, "month": "strftime(order_date, '%Y-%m')"}
_GROUPS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS value, {_CELLS} GROUP BY 2" for d, e in _DIMS.items())


@registry.register("retail_eda", views.cte(f"WITH g AS ({_GROUPS} UNION ALL SELECT 'all' AS dimension, NULL AS value, {_CELLS}), p AS (SELECT *, profit / sales * 100 AS margin_pct, sales / SUM(sales) OVER w * 100 AS share_pct, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY sales DESC, value) AS place, COUNT(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY dimension)) SELECT p.dimension, p.value, p.n, {r('p.sales')} AS sales, {r('p.profit')} AS profit, {r('p.delay_days')} AS delay_days, {r('p.margin_pct')} AS margin_pct, {r('p.share_pct')} AS share_pct, p.place, CASE WHEN dimension = 'month' AND place = 1 THEN 'peak' WHEN dimension = 'month' AND place = k THEN 'lowest' WHEN dimension <> 'month' AND profit < 0 THEN 'loss making' END AS note FROM p"))
def retail_eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales, profit, share, delay and place of every value of six dimensions and over all."""
    rows = _run(spark, sf_dir, "SELECT category, sub_category, region, segment, ship_mode, order_date, ship_date, sales, profit FROM sales")
    return _rounded(orders.breakdown(rows), "sales", "profit", "delay_days", "margin_pct", "share_pct")


@registry.register("retail_order_counts", views.cte("SELECT category AS value, COUNT(DISTINCT order_id) AS n_orders FROM sales GROUP BY 1 UNION ALL SELECT NULL, COUNT(DISTINCT order_id) FROM sales"))
def retail_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line of each category, and of any."""
    return orders.distinct_orders(_run(spark, sf_dir, "SELECT category, order_id FROM sales"))


@registry.register("segment_profit_stats", views.cte(f"WITH own AS (SELECT category, sub_category, region, segment, COUNT(*) AS n, AVG(profit) FILTER (profit >= 0) AS gain, AVG(profit) FILTER (profit < 0) AS loss FROM sales GROUP BY 1, 2, 3, 4), wide AS (SELECT category, region, COUNT(*) AS n, AVG(profit) FILTER (profit >= 0) AS gain, AVG(profit) FILTER (profit < 0) AS loss FROM sales GROUP BY 1, 2) SELECT o.category, o.sub_category, o.region, o.segment, CASE WHEN o.n >= 5 THEN 'segment' WHEN w.n >= 5 THEN 'category and region' ELSE 'default' END AS basis, CASE WHEN o.n >= 5 THEN o.n WHEN w.n >= 5 THEN w.n ELSE 0 END AS n_used, {r('COALESCE(CASE WHEN o.n >= 5 THEN o.gain WHEN w.n >= 5 THEN w.gain END, 50)')} AS gain, {r('COALESCE(CASE WHEN o.n >= 5 THEN o.loss WHEN w.n >= 5 THEN w.loss END, -50)')} AS loss FROM own o JOIN wide w ON w.category = o.category AND w.region = o.region"))
def segment_profit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gain and loss of every segment, from wider groups where it has few orders."""
    return _rounded(orders.segment_profits(_run(spark, sf_dir, "SELECT category, sub_category, region, segment, profit FROM sales")), "gain", "loss")


@registry.register("retail_training_series", views.cte(f"WITH m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, SUM(sales) AS y FROM sales GROUP BY 1) SELECT month, {r('y')} AS y, CASE WHEN month > (SELECT MAX(month) FROM m) - INTERVAL '6' MONTH THEN 'test' ELSE 'train' END AS part FROM m"))
def retail_training_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sales, the last six months held out."""
    return _rounded(orders.monthly_sales(_run(spark, sf_dir, "SELECT order_date, sales FROM sales")), "y")


_PSI_COLUMNS = ("sales", "profit", "quantity", "discount", "line_no", "delay")
_PSI_ROWS = "SELECT order_date >= DATE '2000-01-01' AS recent, sales, profit, quantity, discount, line_no, ship_date - order_date AS delay FROM sales"
_PSI_EDGES = ", ".join(f"percentile_cont({k / 10}) WITHIN GROUP (ORDER BY x)" for k in range(11))


@registry.register("psi_retail_numeric", views.cte("WITH t AS (" + _PSI_ROWS + "), f AS (" + " UNION ALL ".join(f"SELECT recent, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM t" for c in _PSI_COLUMNS) + f"), e AS (SELECT feature, CASE WHEN COUNT(DISTINCT x) < 10 THEN list_sort(list(DISTINCT x)) ELSE list_sort(list_distinct([{_PSI_EDGES}])) END AS edges FROM f WHERE NOT recent GROUP BY 1), b AS (SELECT f.feature, f.recent, len(list_filter(e.edges, lambda v: v <= f.x)) AS bin FROM f JOIN e ON e.feature = f.feature), n AS (SELECT feature, COUNT(*) FILTER (NOT recent) AS n0, COUNT(*) FILTER (recent) AS n1 FROM f GROUP BY 1), every AS (SELECT feature, unnest(generate_series(1, len(edges))) AS bin FROM e), s AS (SELECT v.feature, GREATEST(0.001e0, COUNT(b.bin) FILTER (NOT b.recent) * 1e0 / MIN(n.n0)) AS p, GREATEST(0.001e0, COUNT(b.bin) FILTER (b.recent) * 1e0 / MIN(n.n1)) AS q FROM every v JOIN n ON n.feature = v.feature LEFT JOIN b ON b.feature = v.feature AND b.bin = v.bin GROUP BY v.feature, v.bin) SELECT feature, CAST(COUNT(*) AS INT) AS n_bins, {r('SUM((p - q) * ln(p / q))')} AS psi FROM s GROUP BY 1"))
def psi_retail_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability index of the orders' numbers, older against recent years."""
    rows = _run(spark, sf_dir, _PSI_ROWS.replace("ship_date - order_date", "date_diff(ship_date, order_date)"))
    return _rounded(orders.stability(rows, F.col("recent"), _PSI_COLUMNS), "psi")


_BUCKET = "CAST(CAST(floor(value / 10) * 10 AS INT) AS VARCHAR)"


@registry.register("request_log_summary", f"SELECT 'total' AS section, NULL AS label, COUNT(*) AS n, {r('AVG(value)')} AS latency FROM events UNION ALL SELECT 'endpoint', event_type, COUNT(*), {r('AVG(value)')} FROM events GROUP BY 2 UNION ALL SELECT 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00'), COUNT(*), {r('AVG(value)')} FROM events GROUP BY 2 UNION ALL SELECT 'latency', {_BUCKET}, COUNT(*), {r('AVG(value)')} FROM events GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'newest', CAST(event_id AS VARCHAR), ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS k, {r('value')} FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) t")
def request_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in all, by endpoint, hour and latency, and the last twenty; events stand in for the log."""
    log = _run(spark, sf_dir, "SELECT event_id AS request_id, ts AS at, event_type AS endpoint, value AS latency FROM events")
    return _rounded(orders.request_report(log), "latency")


#: Estimates of two computations, the later with the wider band; two commodities' fits have collapsed.
_STORED = f"WITH {tables([10, 20], ['triangular'])} SELECT commodity, CASE WHEN commodity IN ('PROMO', 'SMALL') THEN 1e-9 ELSE effect END AS effect, p AS p_value, n_left, n_right, bw AS computed_at, bw AS id FROM fit"
_BODY = _STORED[_STORED.index("SELECT commodity, CASE") :]
_DUCK_FDR = f"WITH {tables([10, 20], ['triangular'])}, stored AS ({_BODY}), last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY computed_at DESC, id DESC) AS k FROM stored WHERE p_value IS NOT NULL) t WHERE k = 1), fam AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_value, commodity) AS place, COUNT(*) OVER () AS m FROM last WHERE ABS(effect) >= 1e-6), q AS (SELECT f.commodity, LEAST(1e0, (SELECT MIN(g.p_value * g.m / g.place) FROM fam g WHERE g.place >= f.place)) AS q_value FROM fam f)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discoveries.entries(views.run(spark, sf_dir, _STORED, ("panel",)))


@registry.register("fdr_entries", views.cte(f"{_DUCK_FDR} SELECT l.commodity, {r('l.effect')} AS effect, {r('l.p_value')} AS p_value, {r('q.q_value')} AS q_value, q.commodity IS NULL AS degenerate, l.n_left, l.n_right FROM last l LEFT JOIN q ON q.commodity = l.commodity"))
def fdr_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest estimate of each commodity with its q-value; collapsed fits are marked and left out of the family."""
    return _rounded(_entries(spark, sf_dir).drop("significant_raw", "significant_fdr"), "effect", "p_value", "q_value")


@registry.register("fdr_summary", views.cte(f"{_DUCK_FDR} SELECT (SELECT COUNT(*) FROM q) AS n_hypotheses, (SELECT COUNT(*) FROM fam WHERE p_value < 0.05) AS n_significant_raw, (SELECT COUNT(*) FROM q WHERE q_value < 0.05) AS n_significant_fdr, (SELECT COUNT(*) FROM last WHERE ABS(effect) < 1e-6) AS n_degenerate, {r('(SELECT COUNT(*) FROM q) * 0.05e0')} AS expected_false, (SELECT COALESCE(string_agg(commodity, ', ' ORDER BY commodity), '') FROM last WHERE ABS(effect) < 1e-6) AS degenerate, (SELECT COALESCE(string_agg(commodity, ', ' ORDER BY commodity), '') FROM q WHERE q_value < 0.05) AS survivors"))
def fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of hypotheses, discoveries and collapsed fits, and their names."""
    return _rounded(discoveries.summary(_entries(spark, sf_dir)), "expected_false")

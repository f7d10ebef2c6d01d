"""Role views: the price panel's tables derived from the given star schema.

Each view is one SQL text that both Spark and the oracle read as a common table
expression, so a query and its check see the same rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from graintide.shared import keep

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

VIEWS = {
    "prices": """SELECT r_name AS state, n_name AS district, s_name AS market, p_type AS commodity, p_brand AS variety,
 CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL ELSE l_returnflag END AS grade,
 CAST(l_shipdate AS DATE) AS arrival_date, l_extendedprice / l_quantity * (1 - l_discount) AS min_price,
 l_extendedprice / l_quantity * (1 + l_tax) AS max_price, l_extendedprice / l_quantity AS modal_price,
 l_orderkey AS src_order, l_linenumber AS src_line, l_partkey AS src_part
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
 JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "district_map": """SELECT r_name AS state, n_name AS district, CONCAT('SUBDIV_', CAST(n_nationkey % 12 AS VARCHAR(4))) AS sub_division
FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 <> 6""",
    "rain_month": """SELECT CONCAT('SUBDIV_', CAST(c_nationkey % 12 AS VARCHAR(4))) AS sub_division, CAST(year(o_orderdate) AS INT) AS year,
 CAST(month(o_orderdate) AS INT) AS month, SUM(o_totalprice) AS rainfall_mm FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3""",
    "rain_normal": "SELECT *, AVG(rainfall_mm) OVER (PARTITION BY sub_division, month) AS normal_mm FROM rain_month",
    "rainfall": """SELECT sub_division, year, month, rainfall_mm, normal_mm,
 CASE WHEN normal_mm > 0 THEN (rainfall_mm - normal_mm) / normal_mm * 100 ELSE 0 END AS departure_pct FROM rain_normal""",
    "monthly": """SELECT commodity, state, district, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month,
 AVG(modal_price) AS avg_price, COUNT(*) AS n FROM prices GROUP BY 1, 2, 3, 4, 5""",
    "panel": """SELECT m.commodity, m.state, m.district, d.sub_division, m.year, m.month, m.avg_price, m.n, r.departure_pct
FROM monthly m JOIN district_map d ON d.state = m.state AND d.district = m.district
 JOIN rainfall r ON r.sub_division = d.sub_division AND r.year = m.year AND r.month = m.month""",
    "daily": "SELECT commodity, arrival_date, AVG(modal_price) AS price, COUNT(*) AS n FROM prices GROUP BY 1, 2",
    "national": "SELECT commodity, year, month, SUM(avg_price * n) / SUM(n) AS avg_price, CAST(SUM(n) AS BIGINT) AS n FROM monthly GROUP BY 1, 2, 3",
    "sales_raw": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, p_name AS product_name, CAST(o_orderdate AS DATE) AS order_date,
 CAST(l_shipdate AS DATE) AS ship_date, l_quantity AS quantity, l_discount * 5 AS discount,
 l_extendedprice * (1 - 5 * l_discount) AS sales, l_extendedprice * (1 - 5 * l_discount) - l_quantity * p_retailprice AS profit,
 r_name AS region, c_mktsegment AS segment, p_type AS category, p_brand AS sub_category, o_orderpriority AS ship_mode
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
 JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "sales_first": """SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, product_name ORDER BY line_no, sales, profit, ship_date) AS seen FROM sales_raw""",
    "sales": """SELECT order_id, line_no, product_name, order_date, ship_date, quantity, discount, sales, profit, region, segment, category,
 sub_category, ship_mode, profit / sales * 100 AS profit_margin,
 CASE WHEN discount = 0 THEN 'No Discount' WHEN discount <= 0.2 THEN 'Low' WHEN discount <= 0.4 THEN 'Medium' ELSE 'High' END AS discount_tier,
 CASE WHEN profit < 0 THEN 1 ELSE 0 END AS is_loss FROM sales_first WHERE seen = 1 AND ship_date >= order_date AND profit IS NOT NULL AND sales > 0""",
}
_ORDER = list(VIEWS)
#: A view reads only views that stand before it.
_NEEDS = {k: [v for v in _ORDER[: _ORDER.index(k)] if v in set(VIEWS[k].replace("(", " ").replace(",", " ").split())] for k in VIEWS}


def cte(sql: str, given: frozenset[str] = frozenset()) -> str:
    """The query with the views that it names, directly or through others, put before it; those ``given`` are there already."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    used: list[str] = []

    def add(view: str) -> None:
        if view in given:
            return
        for v in _NEEDS[view]:
            add(v)
        if view not in used:
            used.append(view)

    for v in VIEWS:
        if v in words:
            add(v)
    if not used:
        return sql
    before = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    return f"WITH {before}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {before} {body}"


def load(spark: SparkSession, sf_dir: str) -> None:
    """Point the table names at one directory; plans made before keep their own files."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """The query over one directory's tables.  Views named in ``kept`` are computed once, into the shared folder, however often the text names them."""
    load(spark, sf_dir)
    for view in kept:
        word = re.compile(rf"\b{view}\b")
        if word.search(sql):
            keep(spark.sql(cte(f"SELECT * FROM {view}")), view).createOrReplaceTempView(f"kept_{view}")
            sql = word.sub(f"kept_{view}", sql)
    return spark.sql(cte(sql))


def over(spark: SparkSession, sql: str, given: dict[str, DataFrame], kept: tuple[str, ...] = ()) -> DataFrame:
    """The query over the caller's own tables in the views' names; views that aren't given are made of those that are.

    Tables take names of their own while the query is resolved, so nothing of the session is hidden or left behind.
    """
    tag, names = uuid.uuid4().hex[:12], {}
    whole = cte(sql, frozenset(given))
    missing = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", whole)]
    if missing:
        raise ValueError(f"the query reads {', '.join(missing)}: give the views that it is made of")
    for view, rows in given.items():
        names[view] = f"{view}_{tag}"
        whole = re.sub(rf"\b{view}\b(?!\s+AS \()", names[view], whole)
        if view in kept:
            rows = keep(rows, view)
        rows.createOrReplaceTempView(names[view])
    try:
        return spark.sql(whole)
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)

"""Text tags, district rain climatology, backfill of an archive, and the wide report of each commodity."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import maintenance, registry, views
from graintide.functions import tagging
from graintide.plans import forecasting, monitoring  # noqa: F401  (they register the report's sections)
from graintide.plans.relational import r
from graintide.shared import folder, keep

# ---- tags ------------------------------------------------------------------------------------

#: What is said of parts and in conversations: an id, a text.
SAID = """SELECT CONCAT('part ', CAST(p_partkey AS VARCHAR(20))) AS id, CONCAT('Will the ', p_name, ' of ', p_brand, ' spike, or should I buy?') AS text FROM part
 UNION ALL SELECT CONCAT('turn ', CAST(conv_id AS VARCHAR(20)), ' ', CAST(turn AS VARCHAR(20))) AS id, MAX(text) AS text FROM conversations GROUP BY conv_id, turn"""
#: Part names and types as aliases of the type; a name of several types takes the least.
ALIASES = "SELECT p_name AS alias, MIN(p_type) AS name FROM part GROUP BY 1 UNION ALL SELECT lower(p_type) AS alias, MIN(p_type) AS name FROM part GROUP BY 1"
DEFAULT_TAG = "STANDARD"
_FLAGS = {k: "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{x}')" for x in v) + ")" for k, v in tagging.INTENTS.items()}
_NONE = "NOT (" + " OR ".join(_FLAGS.values()) + ")"
_SHOWN = ", ".join(f"{f} OR {_NONE} AS {k}" if k in ("effect", "forecast", "risk") else f"{f} AS {k}" for k, f in _FLAGS.items())
_HIT = r"regexp_extract(lower(s.text), concat('(?:^|[^a-z0-9])', regexp_replace(lower(a.alias), '([^a-z0-9 ])', '\\\1', 'g'), '(?:$|[^a-z0-9])'))"

TAG_ORACLE = f"""WITH s AS ({SAID}), a AS ({ALIASES}),
 hit AS (SELECT s.id, a.name, a.alias, strpos(lower(s.text), {_HIT}) + CASE WHEN starts_with({_HIT}, lower(a.alias)) THEN 0 ELSE 1 END AS place FROM s JOIN a ON {_HIT} <> ''),
 best AS (SELECT id, name, ROW_NUMBER() OVER (PARTITION BY id ORDER BY place, length(alias) DESC, name) AS k FROM hit)
SELECT s.id, COALESCE(b.name, '{DEFAULT_TAG}') AS tag, {_SHOWN} FROM s LEFT JOIN best b ON b.id = s.id AND b.k = 1"""


@registry.register("label_intent_and_commodity", TAG_ORACLE)
def label_intent_and_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commodity that each text names first, and the intents that its keywords show."""
    said = views.run(spark, sf_dir, SAID)
    aliases = spark.sql(ALIASES)
    longest = aliases.agg(F.max(F.size(tagging.tokens(F.col("alias"))))).first()[0] or 1
    flags = said.select("id", *[c.alias(k) for k, c in tagging.intents(F.col("text")).items()])
    return tagging.tagged(said, "id", aliases, longest, DEFAULT_TAG).join(flags, "id")


#: Part types without one of their letters, as somebody may have typed them, and nations in capitals.
TYPED = "SELECT CONCAT('typed ', CAST(p_partkey AS VARCHAR(20))) AS id, CONCAT('Price of ', substring(p_type, 1, CAST(p_partkey % length(p_type) AS INT)), substring(p_type, CAST(p_partkey % length(p_type) AS INT) + 2, 100), ' near ', upper(n_name), '?') AS text FROM part JOIN nation ON n_nationkey = p_partkey % 27"


@registry.register("fuzzy_commodity_tags")
def fuzzy_commodity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodity of texts with misspelt names, and their district: an exact name before a close one, neither gives the default."""
    said = keep(views.run(spark, sf_dir, f"{TYPED} UNION ALL {SAID}"), "said")
    texts = tagging.distinct(said)
    aliases = keep(spark.sql(ALIASES), "aliases")
    longest = aliases.agg(F.max(F.size(tagging.tokens(F.col("alias"))))).first()[0] or 1
    exact = keep(tagging.tagged(texts, "n", aliases, longest).filter("tag IS NOT NULL"), "exact")
    close = tagging.fuzzy(texts.join(exact.select("n"), "n", "left_anti"), "n", spark.sql("SELECT DISTINCT p_type AS name FROM part"))
    places = spark.sql("SELECT n_name AS name, n_nationkey AS place FROM nation")
    most = places.agg(F.max(F.size(tagging.tokens(F.col("name"))))).first()[0] or 1
    tags = exact.withColumn("how", F.lit("exact")).unionByName(close.withColumn("how", F.lit("close")))
    district = tagging.listed(texts, "n", places, most).withColumnRenamed("name", "district")
    found = keep(texts.join(tags, "n", "left").join(district, "n", "left").select(F.col("text").alias("_text"), F.coalesce("tag", F.lit(DEFAULT_TAG)).alias("tag"), F.coalesce("how", F.lit("default")).alias("how"), "district"), "found")
    return said.join(found, F.col("text").eqNullSafe(F.col("_text"))).select("id", "tag", "how", "district")


# ---- rain ------------------------------------------------------------------------------------

RAIN = f"""WITH day AS (SELECT r_name AS state, n_name AS district, CAST(o_orderdate AS DATE) AS d, AVG(o_totalprice) AS mm
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3),
 mon AS (SELECT state, district, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, AVG(mm) AS mm FROM day GROUP BY 1, 2, 3, 4),
 norm AS (SELECT state, district, month, AVG(mm) AS normal FROM mon GROUP BY 1, 2, 3)
SELECT m.state, m.district, x.sub_division, m.year, m.month, {r('m.mm', 2)} AS rainfall_mm, {r('n.normal', 2)} AS normal_mm,
 CASE WHEN n.normal > 0 THEN {r('(m.mm - n.normal) / n.normal * 100', 2)} ELSE 0 END AS departure_pct
FROM mon m JOIN norm n ON n.state = m.state AND n.district = m.district AND n.month = m.month JOIN district_map x ON x.state = m.state AND x.district = m.district"""


@registry.register("rain_climatology_district", views.cte(RAIN))
def rain_climatology_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means of daily rain by district against the district's own normal, with its sub-division."""
    return views.run(spark, sf_dir, RAIN)


# ---- backfill --------------------------------------------------------------------------------

_KEYS = ", ".join(maintenance.KEY)
_CUT, _FLOOR = "1999-01-01", "1996-01-01"


def backfill(table: DataFrame, archive: DataFrame, out: str, floor: datetime.date, days: int, today: datetime.date) -> DataFrame:
    """The table with the archive's rows from the floor up to the table's oldest day.

    The archive has a partition column ``year``; windows of ``days`` walk back from the day before the oldest one
    and each is added as a part of ``out`` named by its first day.  A walk that is run again over the same table has the
    same windows and replaces its own parts; over a table that holds some of them it goes on below these.  An empty
    table starts at ``today``.  The table has no row before its oldest day, so a window's rows aren't looked up in it.
    """
    spark = table.sparkSession
    oldest = table.agg(F.min("arrival_date")).first()[0] or today + datetime.timedelta(1)
    if oldest <= floor:
        return table.limit(0)
    shape = maintenance.dated(table, F.lit(today)).schema
    while oldest > floor:
        first = max(floor, oldest - datetime.timedelta(days))
        window = archive.filter(F.col("year").between(first.year, oldest.year) & (F.col("arrival_date") >= F.lit(first)) & (F.col("arrival_date") < F.lit(oldest)))
        maintenance.dated(window, F.lit(today)).write.mode("overwrite").parquet(f"{out}/first={first}")
        oldest = first
    return spark.read.schema(shape).parquet(f"{out}/first=*")


_NUM = ", ".join(f"{r(c)} AS {c}" for c in maintenance.NUMBERS)


@registry.register(
    "backward_backfill",
    views.cte(f"SELECT {_KEYS}, {_NUM} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEYS} ORDER BY min_price, max_price, modal_price) AS k FROM prices WHERE arrival_date >= DATE '{_FLOOR}' AND arrival_date < (SELECT MIN(arrival_date) FROM prices WHERE arrival_date >= DATE '{_CUT}')) t WHERE k = 1"),
)
def backward_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the years before the stored ones, fetched from an archive by year in windows of 400 days down to a floor."""
    rows = views.run(spark, sf_dir, "SELECT *, CAST(year(arrival_date) AS INT) AS year FROM prices")
    place = folder(spark, "archive")
    rows.write.partitionBy("year").parquet(place)
    stored = rows.filter(F.col("arrival_date") >= F.lit(_CUT).cast("date")).drop("year")
    found = backfill(stored, spark.read.parquet(place), folder(spark, "backfill"), datetime.date.fromisoformat(_FLOOR), 400, datetime.date(2001, 6, 30))
    return found.select(*maintenance.KEY, *[F.expr(r(c)).alias(c) for c in maintenance.NUMBERS])


# ---- wide report -----------------------------------------------------------------------------

#: Sections of the report: the query, the columns taken from it.
SECTIONS = {
    "tail": ("tail_risk_report", ("var95", "cvar95", "volatility_pct")),
    "drift": ("drift_report", ("psi", "ks_d", "quality_score")),
    "drawdown": ("max_drawdown", ("max_drawdown_pct",)),
}


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row a commodity from sections of one row a commodity each: their columns, the sections there and missing, and a headline."""
    wide = None
    for name, part in parts.items():
        part = part.withColumn(f"_has_{name}", F.lit(True))
        wide = part if wide is None else wide.join(part, "commodity", "full")
    there = [F.when(F.col(f"_has_{n}"), F.lit(n)) for n in parts]
    gone = [F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in parts]
    out = wide.withColumn("available", F.concat_ws(",", *there)).withColumn("missing", F.concat_ws(",", *gone))
    return out.drop(*[f"_has_{n}" for n in parts]).withColumn("headline", F.concat(F.col("commodity"), F.lit(": "), F.coalesce(F.nullif("available", F.lit("")), F.lit("none"))))


def _wide_oracle() -> str:
    """The sections' own SQL side by side; it stands after the modules that define them."""
    sql, names = registry.known_oracles(), list(SECTIONS)
    parts = [f"(SELECT commodity, {', '.join(cols)}, TRUE AS _has_{n} FROM ({sql[key]}) t{n})" for n, (key, cols) in SECTIONS.items()]
    joined = f"{parts[0]} s0 " + " ".join(f"FULL JOIN {p} s{k} USING (commodity)" for k, p in enumerate(parts[1:], 1))
    there = ", ".join(f"CASE WHEN _has_{n} THEN '{n}' END" for n in names)
    gone = ", ".join(f"CASE WHEN _has_{n} IS NULL THEN '{n}' END" for n in names)
    cols = ", ".join(c for _, more in SECTIONS.values() for c in more)
    return f"SELECT *, commodity || ': ' || CASE WHEN available = '' THEN 'none' ELSE available END AS headline FROM (SELECT commodity, {cols}, concat_ws(',', {there}) AS available, concat_ws(',', {gone}) AS missing FROM {joined}) w"


@registry.register("analytics_report", _wide_oracle())
def analytics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails, drift and drawdown of every commodity in one row."""
    return report({n: registry.queries()[key](spark, sf_dir).select("commodity", *cols) for n, (key, cols) in SECTIONS.items()})

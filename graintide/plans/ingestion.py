"""Raw dates, repairs, batch lineage and streaming twins, each with its own DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.functions import dates
from graintide.shared import folder
from graintide.streaming import events, guard

TODAY = "2001-06-30"
#: The price table's dates spelt in seven ways, one of them not a date.
_RAW = "SELECT *, CASE src_line WHEN 1 THEN {0} WHEN 2 THEN {1} WHEN 4 THEN {2} WHEN 5 THEN {3} WHEN 6 THEN {4} WHEN 7 THEN {5} ELSE CASE WHEN src_part % 2 = 0 THEN 'not-a-date' ELSE ' NaN ' END END AS raw FROM prices"
SPARK_RAW = _RAW.format(*[f"date_format(arrival_date, '{f}')" for f in ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy", "MMM dd, yyyy", "dd.MM.yyyy")])
DUCK_RAW = _RAW.format(*[f"strftime(arrival_date, '{f}')" for f in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%y", "%b %d, %Y", "%d.%m.%Y")])
DUCK_DAY = "CAST(CASE WHEN regexp_full_match(trim(raw), '\\d+/\\d+/\\d\\d') THEN TRY_STRPTIME(trim(raw), '%d/%m/%y') ELSE COALESCE(TRY_STRPTIME(trim(raw), '%Y-%m-%d'), TRY_STRPTIME(trim(raw), '%d/%m/%Y'), TRY_STRPTIME(trim(raw), '%d-%m-%Y'), TRY_STRPTIME(trim(raw), '%b %d, %Y'), TRY_STRPTIME(trim(raw), '%d.%m.%Y')) END AS DATE)"
DUCK_STATUS = f"WITH raw AS ({DUCK_RAW}), d AS (SELECT raw, commodity, {DUCK_DAY} AS day FROM raw), s AS (SELECT day, commodity, CASE WHEN lower(trim(raw)) IN ('', 'nan', 'nat', 'none', 'null', '-') THEN 'missing' WHEN day IS NULL THEN 'unparseable' WHEN day > DATE '{TODAY}' + INTERVAL '1' DAY THEN 'future' WHEN day < DATE '1990-01-01' THEN 'impossible' ELSE 'ok' END AS status FROM d)"
DUCK_SWAP = "CAST(TRY_STRPTIME(strftime(arrival_date, '%Y-%d-%m'), '%Y-%m-%d') AS DATE)"
LATE = f"arrival_date > DATE '{TODAY}' + INTERVAL '1' DAY"


def _today():
    return F.lit(TODAY).cast("date")


@registry.register("classify_date", views.cte(f"{DUCK_STATUS} SELECT status, CASE WHEN status = 'ok' THEN day END AS day, COUNT(*) AS n FROM s GROUP BY 1, 2"))
def classify_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by date and status; today is fixed, and there is no date unless it is ok."""
    raw = views.run(spark, sf_dir, SPARK_RAW)
    return dates.classified(raw, "raw", _today()).groupBy("status", "day").agg(F.count("*").alias("n"))


@registry.register("swap_month_day", views.cte(f"SELECT arrival_date, {DUCK_SWAP} AS swapped, COUNT(*) AS n FROM prices GROUP BY 1, 2"))
def swap_month_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date with month and day exchanged, null where that is no date."""
    rows = views.run(spark, sf_dir, "SELECT arrival_date FROM prices")
    return rows.groupBy("arrival_date").agg(F.count("*").alias("n")).withColumn("swapped", dates.swap_month_day(F.col("arrival_date")))


@registry.register("repair_future_dates", views.cte(f"WITH s AS (SELECT commodity, arrival_date, {LATE} AS late, {DUCK_SWAP} AS swapped FROM prices), f AS (SELECT commodity, late, late AND swapped IS NOT NULL AND swapped <> arrival_date AND swapped <= DATE '{TODAY}' + INTERVAL '1' DAY AS fixed FROM s) SELECT commodity, COUNT(*) AS n_rows, COUNT(*) FILTER (late) AS n_future, COUNT(*) FILTER (fixed) AS repaired, COUNT(*) FILTER (late AND NOT fixed) AS dropped FROM f GROUP BY 1"))
def repair_future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a repair: a future date takes its exchanged form if that is another date and not future; other future rows go."""
    rows = views.run(spark, sf_dir, "SELECT commodity, arrival_date FROM prices")
    limit, swapped = F.date_add(_today(), 1), dates.swap_month_day(F.col("arrival_date"))
    late = F.col("arrival_date") > limit
    fixed = late & F.coalesce((swapped != F.col("arrival_date")) & (swapped <= limit), F.lit(False))
    marked = rows.select("commodity", late.alias("late"), fixed.alias("fixed"))
    return marked.groupBy("commodity").agg(F.count("*").alias("n_rows"), F.count_if("late").alias("n_future"), F.count_if("fixed").alias("repaired"), F.count_if(F.col("late") & ~F.col("fixed")).alias("dropped"))


@registry.register("replace_by_key", views.cte("WITH u AS (SELECT commodity, arrival_date, price, 0 AS gen FROM daily UNION ALL SELECT commodity, arrival_date, price * 2 AS price, 1 AS gen FROM daily WHERE day(arrival_date) = 1) SELECT commodity, gen, COUNT(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity, arrival_date ORDER BY gen DESC) AS k FROM u) t WHERE k = 1 GROUP BY 1, 2"))
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the later generation replace those of the same key; counts by generation."""
    old = views.run(spark, sf_dir, "SELECT commodity, arrival_date, price, 0 AS gen FROM daily")
    new = old.where(F.dayofmonth("arrival_date") == 1).withColumns({"price": F.col("price") * 2, "gen": F.lit(1)})
    merged = old.unionByName(new).groupBy("commodity", "arrival_date").agg(F.max("gen").alias("gen"))
    return merged.groupBy("commodity", "gen").agg(F.count("*").alias("n"))


@registry.register("record_lineage", views.cte("SELECT state, COUNT(*) AS row_count, COUNT(DISTINCT commodity) AS n_commodities, MIN(arrival_date) AS first_date, MAX(arrival_date) AS last_date, COUNT(DISTINCT market) AS n_markets FROM prices GROUP BY 1"))
def record_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a batch (here: a state): its size, date span and distinct keys."""
    return views.run(spark, sf_dir, "SELECT * FROM prices").groupBy("state").agg(
        F.count("*").alias("row_count"), F.countDistinct("commodity").alias("n_commodities"), F.min("arrival_date").alias("first_date"), F.max("arrival_date").alias("last_date"), F.countDistinct("market").alias("n_markets")
    )


@registry.register("tumbling_request_volume", "SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def tumbling_request_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, as parts that a stream adds batch by batch."""
    return events.volume_by_parts(spark, events.source(spark, sf_dir))


@registry.register("late_and_future_guard", "SELECT event_id, event_type, ts >= TIMESTAMP '2024-01-20' AS is_future FROM events WHERE event_id IS NOT NULL")
def late_and_future_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sorted by a stream into those up to a fixed day, late ones among them, and those beyond, put aside."""
    status = F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"), "future").otherwise("ok")
    sinks = guard.guarded(spark, events.source(spark, sf_dir).where("event_id IS NOT NULL"), lambda rows: rows.withColumn("status", status))
    marked = lambda rows, future: rows.select("event_id", "event_type", F.lit(future).alias("is_future"))
    return marked(sinks.accepted, False).unionByName(marked(sinks.quarantined, True))


def _guarded_prices(spark: SparkSession, sf_dir: str) -> guard.Sinks:
    """Raw price rows that arrive as files, sorted by their dates."""
    rows = views.run(spark, sf_dir, SPARK_RAW).select("commodity", "market", "raw", "modal_price", "src_part")
    place = folder(spark, "raw")
    rows.write.parquet(place)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(place)
    return guard.guarded(spark, stream, lambda batch: dates.classified(batch, "raw", _today()))


@registry.register("stream_date_status", views.cte(f"{DUCK_STATUS} SELECT status, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY 1"))
def stream_date_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by date status, from the counts that each batch of the guard wrote."""
    return _guarded_prices(spark, sf_dir).counts.groupBy("status").agg(F.sum("n").alias("n"))


@registry.register("stream_quarantine", views.cte(f"{DUCK_STATUS} SELECT commodity, status, CAST(COUNT(*) AS BIGINT) AS n FROM s WHERE status <> 'ok' GROUP BY 1, 2"))
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declined rows by commodity and reason."""
    return _guarded_prices(spark, sf_dir).quarantined.groupBy("commodity", "status").agg(F.count("*").alias("n"))

"""Price files in their published shapes, read to the ten canonical columns.

Every CSV is read with all columns as text and parsed column by column, so a
type guessed from the first rows never decides what a value is.  Readers take
any path that Spark reads: a file, a folder or a pattern.

Defined cases: rows without date or commodity go, cells that are no number or no
date are null, an input without rows gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.functions import dates
from graintide.functions.text import clean_number, clean_text, header_key
from graintide.shared import folder

TEXTS = ("state", "district", "market", "commodity", "variety", "grade")
PRICES = ("min_price", "max_price", "modal_price")
CANONICAL = (*TEXTS, "arrival_date", *PRICES)

# The published headers of each shape, by canonical column.
ARCHIVE = {
    "state": "State", "district": "District Name", "market": "Market Name", "commodity": "Commodity", "variety": "Variety", "grade": "Grade", "arrival_date": "Price Date",
    "min_price": "Min Price (Rs./Quintal)", "max_price": "Max Price (Rs./Quintal)", "modal_price": "Modal Price (Rs./Quintal)",
}
SNAPSHOT = {
    "state": "State", "district": "District", "market": "Market", "commodity": "Commodity", "variety": "Variety", "grade": "Grade", "arrival_date": "Arrival_Date",
    "min_price": "Min_x0020_Price", "max_price": "Max_x0020_Price", "modal_price": "Modal_x0020_Price",
}
# Other spellings of canonical columns in headers and in API records.
HEADER_ALIASES = {"date": "arrival_date", "arrivaldate": "arrival_date", "mandi": "market", "minprice": "min_price", "maxprice": "max_price", "modalprice": "modal_price", "price": "modal_price"}
RECORD_ALIASES = {"state_name": "state", "district_name": "district", "market_name": "market"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _projected(raw: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Canonical columns by header, the date as trimmed text."""
    cell = lambda c: _quoted(headers[c])
    return raw.select(*[F.trim(cell(c)).alias(c) for c in TEXTS], clean_text(cell("arrival_date")).alias("arrival_date"), *[clean_number(cell(c)).alias(c) for c in PRICES])


def _dated(rows: DataFrame) -> DataFrame:
    return rows.filter("arrival_date IS NOT NULL AND commodity IS NOT NULL").withColumn("arrival_date", dates.parse_date(F.col("arrival_date")))


def agmarknet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Archive export: dates such as 05 Apr 2025 or ISO, prices with thousands commas."""
    return _dated(_projected(_csv(spark, path), ARCHIVE))


def datagov_csv(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot export with URL-encoded blanks in the price headers."""
    return _dated(_projected(_csv(spark, path), SNAPSHOT))


def canonical_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical lower-case columns; the date stays text, for the date rules to judge."""
    return _projected(_csv(spark, path), {c: c for c in CANONICAL}).filter("arrival_date IS NOT NULL AND commodity IS NOT NULL")


def wfp_csv(spark: SparkSession, path: str) -> DataFrame:
    """Food-price export with one price: the commodity is the variety too, the grade is empty, least and most are null."""
    raw = _csv(spark, path).filter("date IS NOT NULL AND commodity IS NOT NULL AND price IS NOT NULL AND trim(admin1) <> ''")
    none = F.lit(None).cast("double")
    name = F.trim("commodity")
    return raw.select(
        F.trim("admin1").alias("state"), F.trim("admin2").alias("district"), F.trim("market").alias("market"), name.alias("commodity"), name.alias("variety"), F.lit("").alias("grade"),
        dates.parse_date(F.col("date")).alias("arrival_date"), none.alias("min_price"), none.alias("max_price"), clean_number(F.col("price")).alias("modal_price"),
    )


def detect_price_format(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, format) of every file: its first line names one of four shapes, or none (null).

    Only the first block of each file is read for it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value"), F.monotonically_increasing_id().alias("nth"))
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "nth").alias("header"))
    has = F.col("header").contains
    name = F.lower(F.regexp_extract("file", "([^/]*)$", 1))
    shape = (
        F.when(has("Price Date") | has("District Name"), "agmarknet_historical")
        .when(has("Arrival_Date") | has("Modal_x0020_Price"), "data_gov_in_snapshot")
        .when(F.lower("header").contains("arrival_date"), "canonical")
        .when(has("date,admin1") | (has("admin1") & name.contains("wfp")), "wfp_food_prices")
    )
    return first.withColumn("format", shape)


def alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any header whose columns have known spellings; the last filled spelling of a column counts, variety and grade default to FAQ."""
    raw = _csv(spark, path)
    keys = [header_key(c) for c in raw.columns]
    raw = raw.toDF(*[f"c{i}" for i in range(len(keys))])
    found: dict[str, list[Column]] = {c: [] for c in CANONICAL}
    for i, key in enumerate(keys):
        if (name := HEADER_ALIASES.get(key, key)) in found:
            found[name].insert(0, F.col(f"c{i}"))
    cell = lambda c: F.coalesce(*found[c]) if found[c] else F.lit(None).cast("string")
    other = {"variety": "FAQ", "grade": "FAQ", "commodity": None}
    texts = [F.coalesce(clean_text(cell(c)), F.lit(other.get(c, ""))).alias(c) for c in TEXTS]
    rows = raw.select(*texts, clean_text(cell("arrival_date")).alias("arrival_date"), *[clean_number(cell(c)).alias(c) for c in PRICES])
    return _dated(rows)


def ingest_folder(spark: SparkSession, drop: str, table: str, state: str, archive: str | None = None) -> DataFrame:
    """Append every canonical CSV of a drop folder to a Parquet table once, as a stream that ends when none is left.

    ``state`` holds which files have been read; with ``archive`` read files move there.
    A batch that is run again replaces its own part.
    """
    schema = ", ".join(f"{c} string" for c in CANONICAL)
    files = spark.readStream.schema(schema).option("header", True)
    if archive:
        files = files.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = _dated(_projected(files.csv(drop), {c: c for c in CANONICAL}))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(table)


def price_json(spark: SparkSession, path: str, today: Column | None = None) -> DataFrame:
    """API records in any of the known spellings; dates that the date rules don't call ok are null, other fields go."""
    names = {c: c for c in CANONICAL} | {"_".join(p.capitalize() for p in c.split("_")): c for c in CANONICAL} | RECORD_ALIASES
    # every spelling is a column of its own, since field names differ by case; a record is parsed once for all of them
    keys = list(names)
    parsed = spark.read.text(path).select(F.json_tuple("value", *keys).alias(*[f"k{i}" for i in range(len(keys))]))
    cell = lambda c: F.coalesce(*[F.col(f"k{i}") for i, k in enumerate(keys) if names[k] == c])
    parsed = parsed.select("*", F.explode(F.array(dates.parse_date(cell("arrival_date")))).alias("day"))  # one element: the date is parsed once, however often it is read
    day = F.when(dates.ok(F.col("day"), today if today is not None else F.current_date()), F.col("day"))
    return parsed.select(*[F.nullif(cell(c), F.lit("")).alias(c) for c in TEXTS], day.alias("arrival_date"), *[clean_number(cell(c)).alias(c) for c in PRICES])


_CEDA_ROW = "struct<date:string,arrival_date:string,t:string,census_district_id:int,district_id:int,min_price:double,p_min:double,max_price:double,p_max:double,modal_price:double,p_modal:double>"
_CEDA = f"output struct<data:array<{_CEDA_ROW}>>, data array<{_CEDA_ROW}>, records array<{_CEDA_ROW}>, results array<{_CEDA_ROW}>, commodity_id int, state_id int"


def ceda_json(spark: SparkSession, path: str, states: DataFrame, districts: DataFrame, commodities: DataFrame, label: str) -> DataFrame:
    """Envelopes of district rows, one a line with the ids it was asked for; ids become names by three (id, name) tables.

    A district without a name is called by its id, and so is a commodity.
    """
    got = spark.read.schema(_CEDA).json(path)
    rows = got.select("commodity_id", "state_id", F.explode(F.coalesce("output.data", "data", "records", "results")).alias("r")).select("commodity_id", "state_id", "r.*")
    rows = rows.withColumn("district_id", F.coalesce("census_district_id", "district_id")).withColumn("arrival_date", F.substring(F.coalesce("date", "arrival_date", "t"), 1, 10)).filter("arrival_date IS NOT NULL")
    named = lambda side, key, out: side.select(F.col("id").alias(key), F.col("name").alias(out))
    rows = rows.join(named(states, "state_id", "state"), "state_id", "left").join(named(districts, "district_id", "named"), "district_id", "left").join(named(commodities, "commodity_id", "item"), "commodity_id", "left")
    district = F.coalesce("named", F.concat(F.lit("district "), F.col("district_id").cast("string")))
    price = lambda a, b: F.coalesce(a, b)
    return rows.select(
        "state", district.alias("district"), district.alias("market"), F.coalesce("item", F.concat(F.lit("id:"), F.col("commodity_id").cast("string"))).alias("commodity"), F.lit(label).alias("variety"), F.lit(label).alias("grade"),
        dates.parse_date(F.col("arrival_date")).alias("arrival_date"), price("min_price", "p_min").alias("min_price"), price("max_price", "p_max").alias("max_price"), price("modal_price", "p_modal").alias("modal_price"),
    )


def monthly_cell_json(spark: SparkSession, path: str) -> DataFrame:
    """Monthly archive cells, dated on the first of their month; market is the district, variety and grade the commodity."""
    raw = spark.read.schema("t string, arrival_date string, cmdty string, commodity string, district string, district_name string, state string, state_name string, p_min double, p_max double, p_modal double").json(path)
    first = lambda *names: F.coalesce(*[clean_text(F.col(c)) for c in names], F.lit(""))
    month = F.substring(F.coalesce(clean_text(F.col("t")), F.col("arrival_date")), 1, 7)
    item, district = first("cmdty", "commodity"), first("district", "district_name")
    return raw.filter(month.isNotNull()).select(
        first("state", "state_name").alias("state"), district.alias("district"), district.alias("market"), item.alias("commodity"), item.alias("variety"), item.alias("grade"),
        F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date").alias("arrival_date"), F.col("p_min").alias("min_price"), F.col("p_max").alias("max_price"), F.col("p_modal").alias("modal_price"),
    )


def written_canonical(df: DataFrame, path: str | None = None) -> str:
    """Write the ten canonical columns as CSV with a header; absent columns, nulls and NaN are empty cells.  Returns the path."""
    path = path or folder(df.sparkSession, "canonical")
    cell = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    number = lambda c: F.nullif(cell(c).cast("double"), F.lit(float("nan")))
    df.select(*[(number(c) if c in PRICES else cell(c)).alias(c) for c in CANONICAL]).write.csv(path, header=True, nullValue="", emptyValue="")
    return path

"""Raw text dates to dates with a status, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a whole text of a shape becomes, year first, or day, month's name and year; and the texts that mean "no date".
NUMBERS = (
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})\z", "$4-$3-$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})\z", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(69|[789]\d)\z", "19$3-$2-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d\d)\z", "20$3-$2-$1"),
    (r"^(\d{4})(\d\d)(\d\d)\z", "$1-$2-$3"),
)
NAMES = ((r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})\z", "$2 $1 $3"), (r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})\z", "$1 $2 $3"))
MISSING = ("", "nan", "nat", "none", "null", "-")
#: Numbers beyond EPOCH_MS are milliseconds, and seconds lie within EPOCH.
EPOCH, EPOCH_MS = (3.0e8, 4.5e9), 1e11


def _text(raw: Column) -> Column:
    """Trimmed, runs of blanks as one, a whole number's trailing .0 dropped, and what follows ten characters of an ISO date."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s+", " "), r"^(\d+)\.0\z", "$1")
    return F.regexp_replace(text, r"(?s)^(\d{4}-\d{2}-\d{2})\D.*\z", "$1")


def parse_date(raw: Column) -> Column:
    """The date of a text whose shape is known; null where none fits.  What follows ten characters of an ISO date is dropped.

    Two digits of a year from 69 on are of the century before.  Each step reads the text once, so that the
    expression stays small and compiles wherever it stands; texts of the commonest shape take none of them.
    """
    number = name = _text(raw)
    for shape, form in NUMBERS:
        number = F.regexp_replace(number, shape, form)
    for shape, form in NAMES:
        name = F.regexp_replace(name, shape, form)
    year_first = F.regexp_extract(number, r"^\d{4}-\d{1,2}-\d{1,2}\z", 0).try_cast("date")
    named = F.try_to_timestamp(F.regexp_extract(name, r"^\d{1,2} [A-Za-z]{3} \d{4}\z", 0), F.lit("d MMM yyyy")).cast("date")
    iso = F.when(raw.rlike(r"^\d{4}-\d\d-\d\d\z"), raw.try_cast("date"))
    return F.coalesce(iso, year_first, named)


def parse_epoch(number: Column) -> Column:
    """The UTC date of seconds or milliseconds since 1970; null where the number can't be either."""
    x = number.cast("double")
    seconds = F.when(x > EPOCH_MS, x / 1000).otherwise(x)
    return F.when(seconds.between(*EPOCH), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")))


def parsed(df: DataFrame, column: str) -> Column:
    """The date of a column by its type: dates as they are, numbers as epochs where they can be, else as texts."""
    kind, raw = df.schema[column].dataType.typeName(), F.col(column)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return raw.cast("date")
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        whole = F.when(raw == F.floor(raw), F.floor(raw).cast("string"))
        return F.coalesce(parse_epoch(raw), parse_date(whole))
    return parse_date(raw.cast("string"))


def classified(df: DataFrame, column: str, today: Column, floor: str = "1990-01-01", ahead: int = 1) -> DataFrame:
    """df with ``day`` and ``status`` of a raw date column; the day is null unless the status is ok, so a declined date can't be stored."""
    steps = df.withColumn("day", parsed(df, column))
    status = _status(F.col(column).cast("string"), F.col("day"), today, floor, ahead)
    return steps.withColumn("status", status).withColumn("day", F.when(F.col("status") == "ok", F.col("day")))


def _status(raw: Column, day: Column, today: Column, floor: str, ahead: int) -> Column:
    return (
        F.when(raw.isNull() | F.lower(F.trim(raw)).isin(*MISSING), "missing")
        .when(day.isNull(), "unparseable")
        .when(day > F.date_add(today, ahead), "future")
        .when(day < F.lit(floor).cast("date"), "impossible")
        .otherwise("ok")
    )


def date_status(raw: Column, today: Column, floor: str = "1990-01-01", ahead: int = 1) -> Column:
    """ok, missing, unparseable, future (after tomorrow) or impossible (before ``floor``); null text is missing."""
    return _status(raw, parse_date(raw), today, floor, ahead)


def ok(day: Column, today: Column, floor: str = "1990-01-01", ahead: int = 1) -> Column:
    """Whether a parsed date is what ``date_status`` calls ok; the texts that mean "no date" have none."""
    return day.between(F.lit(floor).cast("date"), F.date_add(today, ahead))


def swap_month_day(day: Column) -> Column:
    """Month and day exchanged; null where that is no date."""
    return F.try_to_timestamp(F.date_format(day, "yyyy-dd-MM"), F.lit("yyyy-MM-dd")).cast("date")

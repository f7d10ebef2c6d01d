"""Cleaning of text cells, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value".
MISSING = ("", "na", "nan", "none", "null", "-")


def clean_text(c: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_number(c: Column) -> Column:
    """A number without its thousands commas; null where the text means none or is no finite number."""
    # of the texts in MISSING only nan is a number at all; nanvl reads the number once
    return F.nanvl(F.translate(F.trim(c), ",", "").try_cast("double"), F.lit(None).cast("double"))


def header_key(name: str) -> str:
    """A header in lower case with blanks, also URL-encoded ones, as underscores."""
    return name.strip().lower().replace("_x0020_", "_").replace("x0020", "_").replace(" ", "_")

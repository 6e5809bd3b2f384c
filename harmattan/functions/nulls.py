"""Missing-value tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# Tokens that count as empty when the structure of a table is cleaned.
STRUCTURE_SENTINELS = ["", "N/A", "n/a", "NA", "-", "—", "#"]

# Tokens that count as missing when conflicts are searched.
CONFLICT_SENTINELS = ["", "NULL"]


def stripped(c: Column) -> Column:
    """The value as text without leading and trailing whitespace of any kind."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def is_missing(c: Column) -> Column:
    """Null, or blank after trimming."""
    return F.coalesce(stripped(c), F.lit("")) == ""


def is_structurally_empty(c: Column) -> Column:
    """Null, blank or one of the placeholder tokens people type into empty cells."""
    return F.coalesce(stripped(c), F.lit("")).isin(STRUCTURE_SENTINELS)


def is_conflict_missing(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).isin(CONFLICT_SENTINELS)


def data_columns(df: DataFrame) -> list[str]:
    """Business columns: everything but the technical ones, which start with an underscore."""
    return [name for name in df.columns if not name.startswith("_")]


def missing_count(columns: list[str], test=is_missing) -> Column:
    """Number of missing cells in a row."""
    total = F.lit(0)
    for name in columns:
        total = total + test(F.col(name)).cast("int")
    return total

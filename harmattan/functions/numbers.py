"""Numbers held as text: amounts with currencies, decimals, rounding and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmattan.functions.bind import once
from harmattan.functions.nulls import stripped

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Currency tokens recognised in amounts. The look-ahead passes over places where none begins.
CURRENCY = r"(?i)(?=[fxeug€$£])(fcfa|f\s*cfa|xof|eur|usd|gbp|€|\$|£)"

# Magnitude suffixes.
SUFFIX = r"(?i)(?=[mb])(m|mn|million|mds|md|b|bn|milliard)$"
MILLIONS = ["m", "mn", "million"]
BILLIONS = ["mds", "md", "b", "bn", "milliard"]

# XOF per unit of currency.
XOF_RATES = {
    "EUR": 655.957,
    "USD": 600.0,
    "GBP": 770.0,
    "GHS": 52.0,
    "NGN": 0.42,
    "XAF": 1.0,
    "GNF": 0.069,
}


def to_double(c: Column) -> Column:
    """Text to double, null when it is not a plain number (``12d`` and ``NaN`` are not)."""
    return F.regexp_extract(stripped(c), NUMBER, 0).try_cast("double")


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a number; numeric columns pass untouched so filters still push down."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.col(name).cast("int")
    return to_double(F.col(name))


def parse_decimal(c: Column) -> Column:
    """Spaces dropped, comma as decimal point, DECIMAL(20,4) or null."""
    text = F.replace(F.regexp_replace(c.cast("string"), r"[\s\u00a0]", ""), F.lit(","), F.lit("."))
    return F.regexp_extract(text, NUMBER, 0).try_cast("decimal(20,4)")


def parse_amount(c: Column) -> Column:
    """Text amount to ``struct(value, currency)``.

    Brackets mean negative, M/Mds/B scale. A single comma after which no dot follows is the
    decimal mark and dots before it group thousands; other commas, or several dots, group.
    Each step is computed once a cell.
    """
    return once(stripped(c), _amount)


def _amount(raw: Column) -> Column:
    sign = F.when(raw.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
    token = F.upper(F.replace(F.regexp_extract(raw, CURRENCY, 1), F.lit(" "), F.lit("")))
    compact = F.regexp_replace(F.regexp_replace(raw, CURRENCY, ""), r"[ \u00a0()]", "")
    value = once(compact, _scaled) * sign
    currency = F.coalesce(F.nullif(token, F.lit("")), F.lit("XOF"))
    return once(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), currency).alias("currency")))


def _scaled(compact: Column) -> Column:
    scales = F.create_map(F.lit(""), F.lit(1.0), *[F.lit(x) for w in MILLIONS for x in (w, 1e6)], *[F.lit(x) for w in BILLIONS for x in (w, 1e9)])
    scale = F.try_element_at(scales, F.lower(F.regexp_extract(compact, SUFFIX, 1)))
    marked = F.regexp_replace(F.regexp_replace(compact, SUFFIX, ""), r"^([^,]*),([^,.]*)$", "$1;$2")
    plain = once(marked, lambda m: (
        F.when(m.contains(";"), F.translate(m, ";.", "."))
        .when(m.rlike(r"^[^,.]*\.[^,.]*\.[^,]*$"), F.translate(m, ".", ""))
        .otherwise(F.translate(m, ",", ""))
    ))
    return F.regexp_extract(plain, NUMBER, 0).try_cast("double") * scale


def to_xof(amount: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Convert by a small fixed rate table; unknown currencies keep their value."""
    pairs = [part for code, rate in (rates or XOF_RATES).items() for part in (F.lit(code), F.lit(float(rate)))]
    rate = F.try_element_at(F.create_map(*pairs), currency)
    return F.when(rate.isNotNull() & (currency != "XOF"), F.bround(amount * rate)).otherwise(amount)


def convert(c: Column, dtype: str, decimals: int = 4, dayfirst: bool = False) -> Column:
    """Type conversion of a text cell; cells that cannot convert keep their text."""
    text = stripped(c)
    blank = F.coalesce(text, F.lit("")) == ""
    number = to_double(c)
    if dtype == "string":
        out = text
    elif dtype == "integer":
        out = F.coalesce(number.try_cast("bigint").cast("string"), c.cast("string"))
    elif dtype == "float":
        out = F.coalesce(F.bround(number, decimals).cast("string"), c.cast("string"))
    elif dtype == "boolean":
        low = F.lower(text)
        out = (
            F.when(low.isin("true", "1", "yes", "y", "oui"), "true")
            .when(low.isin("false", "0", "no", "n", "non"), "false")
            .otherwise(c.cast("string"))
        )
    elif dtype == "date":
        from harmattan.functions.dates import parse_date

        out = F.coalesce(parse_date(c, dayfirst, local_forms=False).cast("string"), c.cast("string"))
    else:
        raise ValueError(f"unknown dtype {dtype!r}")
    return F.when(~blank, out)


def spaced(c: Column, decimals: int = 0) -> Column:
    """Thousands separated by spaces."""
    return F.replace(F.format_number(c.cast("double"), decimals), F.lit(","), F.lit(" "))


def format_fcfa(c: Column, aggregation: str) -> Column:
    """Display form of a pivot cell for the given aggregate."""
    if aggregation == "count":
        return F.concat(spaced(c), F.lit(" commandes"))
    if aggregation == "std":
        return F.concat(F.lit("±"), spaced(c), F.lit(" FCFA"))
    if aggregation in ("avg", "mean", "median"):
        return F.concat(spaced(c), F.lit(" FCFA (moy.)"))
    return F.concat(spaced(c), F.lit(" FCFA"))

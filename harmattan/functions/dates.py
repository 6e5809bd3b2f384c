"""Date parsing, calendar buckets and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harmattan.functions.bind import once
from harmattan.functions.nulls import stripped

# Month names, French and English, with the month number.
ENGLISH_MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6,
    "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "october": 10, "oct": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12,
}
MONTHS = ENGLISH_MONTHS | {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avr": 4, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
}

# Spellings as (pattern, year-month-day replacement), tried in order.
YEAR_FIRST = [(r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})([T ].*)?$", "$1-$2-$3"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")]
SMALL_FIRST = [
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})([T ].*)?$", ""),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-]([5-9]\d)([T ].*)?$", "19"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-]([0-4]\d)([T ].*)?$", "20"),
]
DAY_NAME_YEAR = r"^(\d{1,2})\s+([A-Za-zÀ-ÿ]+)\.?\s+(\d{4}|\d{2})$"
NAME_DAY_YEAR = r"^([A-Za-zÀ-ÿ]+)\.?\s+(\d{1,2}),?\s+(\d{4})$"
TIME_BUCKETS = ("mois", "trimestre", "semestre", "annee", "semaine")


def _reordered(text: Column, pattern: str, replacement: str) -> Column:
    """The parts of a whole-text match in year-month-day order, null when impossible or unmatched."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, replacement).try_cast("date")


def _named(text: Column, months: dict[str, int], pattern: str, day: int, name: int, year: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in months.items() for x in (k, f"-{v}-")])
    month = F.try_element_at(table, F.lower(F.regexp_extract(text, pattern, name)))
    full = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, pattern, year), r"^([5-9]\d)$", "19$1"), r"^([0-4]\d)$", "20$1")
    return F.concat(full, month, F.regexp_extract(text, pattern, day)).try_cast("date")


def parse_date(c: Column, dayfirst: bool = True, local_forms: bool = True) -> Column:
    """Any of the supported spellings to DATE; impossible dates become null.

    Compact yyyymmdd, year-first, day-first (the other order when only that reading exists)
    and English month names are understood; ``local_forms`` adds spreadsheet serial numbers
    and French month names.
    """
    text = stripped(c)
    if local_forms:
        text = F.regexp_replace(text, r"1(?<=\b1)[eE][rR]\b", "1")
    return once(text, lambda x: _parsed(x, dayfirst, local_forms))


def _parsed(text: Column, dayfirst: bool, local_forms: bool) -> Column:
    orders = ("$3-$2-$1", "$3-$1-$2") if dayfirst else ("$3-$1-$2", "$3-$2-$1")
    small_first = [_reordered(text, p, century + order) for order in orders for p, century in SMALL_FIRST]
    months = MONTHS if local_forms else ENGLISH_MONTHS
    named = [_named(text, months, DAY_NAME_YEAR, 1, 2, 3), _named(text, months, NAME_DAY_YEAR, 2, 1, 3)]
    digits = [_reordered(text, *YEAR_FIRST[1])]
    if local_forms:
        serial = F.regexp_extract(text, r"^\d{4,6}$", 0).try_cast("int")
        digits.append(once(serial, lambda n: F.date_add(F.lit("1899-12-30").cast("date"), F.when(n.between(1000, 100000), n))))
    # The shape of the beginning picks the family, so a cell meets few patterns.
    return (
        F.when(text.rlike(r"^\d{4}[/.-]"), _reordered(text, *YEAR_FIRST[0]))
        .when(text.rlike(r"^\d{1,2}[/.-]"), F.coalesce(*small_first))
        .when(text.rlike(r"^\d+$"), F.coalesce(*digits))
        .otherwise(F.coalesce(*named))
    )


def parse_ranking_date(c: Column) -> Column:
    """The narrower list used by rankings: ISO, d/m/y, m/d/y, y/m/d, d-m-y."""
    text = stripped(c)
    formats = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy"]
    parsed = [F.try_to_date(text, fmt) for fmt in formats]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(*parsed, iso)


def time_bucket(c: Column, kind: str) -> Column:
    """Calendar bucket label; a null date stays null and weeks carry their ISO year."""
    d = c.cast("date")
    year = F.year(d).cast("string")
    if kind == "mois":
        return F.date_format(d, "yyyy-MM")
    if kind == "trimestre":
        return F.concat(year, F.lit("Q"), F.quarter(d).cast("string"))
    if kind == "semestre":
        return F.concat(year, F.lit("-S"), F.ceil(F.month(d) / 6).cast("string"))
    if kind == "annee":
        return year
    if kind == "semaine":
        iso_year = F.extract(F.lit("YEAROFWEEK"), d).cast("string")
        return F.concat(iso_year, F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    raise ValueError(f"unknown time bucket {kind!r}")


def period_label(start: Column, end: Column, frequency: Column) -> Column:
    """Readable label of a KPI period by its frequency."""
    end, start = end.cast("date"), start.cast("date")
    year = F.year(end).cast("string")
    week = F.floor((F.dayofyear(end) + 6 - F.weekday(end)) / 7)
    return (
        F.when(frequency == "daily", F.date_format(end, "yyyy-MM-dd"))
        .when(frequency == "weekly", F.concat(F.lit("W"), F.lpad(week.cast("string"), 2, "0"), F.lit(" "), year))
        .when(frequency == "monthly", F.date_format(end, "MMMM yyyy"))
        .when(frequency == "quarterly", F.concat(F.lit("Q"), F.quarter(end).cast("string"), F.lit(" "), year))
        .when(frequency == "yearly", year)
        .otherwise(F.concat(start.cast("string"), F.lit(" to "), end.cast("string")))
    )


def default_period(as_of: Column, days: int = 30) -> tuple[Column, Column]:
    """Period start and end when none is given: the last thirty days."""
    end = as_of.cast("date")
    return F.date_sub(end, days), end

"""Text expressions: case, normalisation, similarity, extraction and repair."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harmattan.functions.bind import once
from harmattan.functions.nulls import is_missing, stripped

# Placeholders that stand for "no value" in text columns.
TEXT_SENTINELS = [
    "n/a", "na", "n.a.", "#n/a", "#ref!", "#valeur!", "null", "none", "nil", "—", "-", "--", "...", ".",
    "à compléter", "inconnu", "unknown", "???", "xxx", "xxxxx", "non renseigné", "vide", "empty", "test", "exemple",
]
# Particles kept in lower case inside a name, and acronyms kept in capitals.
PARTICLES = ["de", "du", "la", "le", "les", "et", "au", "aux", "à", "en", "pour"]
ACRONYMS = ["FCFA", "BF", "PME", "ERP", "SA", "SARL", "SAS", "UEMOA"]
# Fields in which a bare zero means "no value".
ZERO_IS_NULL_FIELDS = ("client", "produit", "categorie", "vendeur", "region")
# Letters read for digits.
AMBIGUOUS = {
    "i": "1", "I": "1", "o": "0", "O": "0", "l": "1", "s": "5", "S": "5", "B": "8", "G": "6", "Z": "2",
}
VALUE_UNIT = r"^([+-]?\d+(?:[.,]\d+)?)\s*([a-zA-Z].*)$"


def title_case(c: Column) -> Column:
    """Capital after every non-letter, so ``o'neil-x`` becomes ``O'Neil-X``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    capital = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    return F.array_join(capital, "")


def standardize(c: Column, mode: str = "trim_lower") -> Column:
    text = stripped(c)
    changed = {"trim": text, "upper": F.upper(text), "lower": F.lower(text), "title": title_case(text), "trim_lower": F.lower(text)}
    return F.when((c == "") | c.isNull(), c).otherwise(changed.get(mode, text))


def normalize(c: Column, mode: str = "upper", mapping: Mapping[str, str] | None = None, decimals: int = 2) -> Column:
    """One of upper, lower, date_iso, currency_code, numeric; unparseable cells stay as they are."""
    from harmattan.functions.dates import parse_date
    from harmattan.functions.numbers import to_double

    if mode == "upper":
        out = F.upper(c)
    elif mode == "lower":
        out = F.lower(c)
    elif mode == "date_iso":
        out = F.coalesce(parse_date(c, dayfirst=False, local_forms=False).cast("string"), c)
    elif mode == "currency_code":
        code = F.upper(stripped(c))
        out = map_values(code, mapping or {})
    elif mode == "numeric":
        out = F.coalesce(F.bround(to_double(c), decimals).cast("string"), c)
    else:
        out = c
    return F.when((c == "") | c.isNull(), c).otherwise(out)


def java_replacement(replacement: str) -> str:
    r"""``\1`` and ``\g<1>`` back-references to ``$1``; a literal dollar is escaped."""
    escaped = replacement.replace("$", r"\$")
    return re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: f"${m.group(1) or m.group(2)}", escaped)


def regex_replace(c: Column, pattern: str, replacement: str) -> Column:
    return F.when((c == "") | c.isNull(), c).otherwise(F.regexp_replace(c, pattern, java_replacement(replacement)))


def matches_format(c: Column, pattern: str) -> Column:
    """Anchored at the start like a match, not a search; blank cells are not judged."""
    return F.when((c == "") | c.isNull(), F.lit(True)).otherwise(c.rlike(f"^(?:{pattern})"))


def map_values(c: Column, mapping: Mapping[str, str], case_insensitive: bool = False) -> Column:
    """Replace listed values, keep the others."""
    if not mapping:
        return c
    table = {(str(k).lower() if case_insensitive else str(k)): str(v) for k, v in mapping.items()}
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    key = F.lower(c) if case_insensitive else c
    return F.coalesce(F.try_element_at(pairs, key), c)


def split_part(c: Column, separator: str, index: int) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), re.escape(separator))
    return F.get(parts, F.lit(index))


def merge_parts(columns: Sequence[Column], separator: str = " ") -> Column:
    """Trimmed non-blank parts joined; empty text when all are blank."""
    return F.concat_ws(separator, *[F.when(~is_missing(c), stripped(c)) for c in columns])


def normalize_text(c: Column, field: str = "") -> Column:
    """Entity names: whitespace and punctuation tidied, placeholders to null, words capitalised."""
    text = F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f\u200b\u00a0\ufeff]", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, r"([!?.,])\1+", "$1")

    def word(w: Column, i: Column) -> Column:
        return once(F.upper(w), lambda up: (
            F.when(up.isin(ACRONYMS), up)
            .when((i > 0) & F.lower(w).isin(PARTICLES), F.lower(w))
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
        ))

    def tidied(x: Column) -> Column:
        sentinel = F.lower(x).isin(TEXT_SENTINELS) | (x == "")
        if field in ZERO_IS_NULL_FIELDS:
            sentinel = sentinel | (x == "0")
        return F.when(~sentinel, F.rtrim(F.array_join(F.transform(F.split(x, " "), word), " "), F.lit(".")))

    return once(text, tidied)


def token_sorted(c: Column) -> Column:
    """Lower-case alphanumeric tokens in order, so word order does not matter."""
    clean = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.array_join(F.array_sort(F.split(clean, " ")), " ")


def similarity(left: Column, right: Column) -> Column:
    """0-100 from the edit distance of two token-sorted texts."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(100)).otherwise(
        F.floor(100 * (longest - F.levenshtein(left, right)) / longest)
    ).cast("int")


def edit_distance(left: Column, right: Column, most: int = 30) -> Column:
    """Edit distance of labels of any length; 99 when it is more than ``most``, which bounds the work."""
    distance = F.levenshtein(left, right, most)
    return F.when(distance < 0, F.lit(99)).otherwise(distance)


def extract_labeled_fields(c: Column, labels: Sequence[str]) -> dict[str, Column]:
    """Text after each label up to the next label found; empty when the label is absent."""
    text = F.coalesce(c, F.lit(""))
    lowered = F.lower(text)
    starts = {label: F.locate(label.lower(), lowered) for label in labels}
    positions = F.array(*starts.values())

    def field(label: str, start: Column) -> Column:
        later = F.array_min(F.filter(positions, lambda p: p > start))
        begin = start + len(label)
        end = F.coalesce(later, F.length(text) + 1)
        value = F.when(end > begin, text.substr(begin, end - begin)).otherwise("")
        return F.when(start > 0, stripped(value)).otherwise("")

    return {label: field(label, start) for label, start in starts.items()}


def fix_ambiguous(c: Column, substitutions: Mapping[str, str] | None = None, uncertain: Sequence[str] = ()) -> Column:
    """Letters read for digits replaced, unless the whole value is listed as uncertain."""
    table = dict(AMBIGUOUS if substitutions is None else substitutions)
    if all(len(k) == 1 and len(v) == 1 for k, v in table.items()) and not set(table) & set(table.values()):
        fixed = F.translate(c, "".join(table), "".join(table.values()))
    else:
        fixed = c
        for wrong, right in table.items():
            fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    fixed = F.coalesce(fixed, F.lit(""))
    return F.when(c.isin(list(uncertain)), c).otherwise(fixed) if uncertain else fixed


def split_value_unit(c: Column) -> tuple[Column, Column]:
    """``12,5kg`` to (``12.5``, ``kg``); without a match the text stays in the number part."""
    text = F.coalesce(stripped(c), F.lit(""))
    hit = text.rlike(VALUE_UNIT)
    number = F.replace(F.regexp_extract(text, VALUE_UNIT, 1), F.lit(","), F.lit("."))
    unit = stripped(F.regexp_extract(text, VALUE_UNIT, 2))
    return F.when(hit, number).otherwise(F.coalesce(c, F.lit(""))), F.when(hit, unit).otherwise("")

"""Scalar rules shared by every table: numbers, fallbacks, labels, parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Championship points by finishing position.
POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}

# Practice session names and their short labels.
SESSION_LABELS = {"Practice 1": "FP1", "Practice 2": "FP2", "Practice 3": "FP3"}

# Stored status words and the words shown to users.
STATUS_WORDS = {"success": "done", "failed": "error"}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# -- numbers -----------------------------------------------------------------


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(text: Column) -> Column:
    """Text to double, null when it is not a plain decimal number.

    Java accepts a trailing ``d``/``f`` and hexadecimal floats, which are not
    numbers here; the spelled-out infinities are.
    """
    infinity = text.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    java_only = text.rlike(r"[dDfF]\s*$|[xX]")
    return nan_to_null(F.when(infinity | ~java_only, text.try_cast("double")))


def leading_int(text: Column) -> Column:
    """The integer at the start of a text, null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def leading_number(text: Column) -> Column:
    """The decimal number at the start of a text, null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def clamp(x: Column, fallback: float, low: float = 0.0, high: float | None = None) -> Column:
    """Bound a double to [low, high]; a missing or non-finite value becomes the unbounded fallback."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    bounded = F.greatest(F.lit(low), x)
    if high is not None:
        bounded = F.least(F.lit(high), bounded)
    return F.when(finite, bounded).otherwise(F.lit(fallback))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-null values in a row, null when there are none."""
    total = reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    present = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, total / present)


def interval_seconds(c: Column) -> Column:
    """A day-time interval in seconds, fractions kept."""
    whole = (
        F.extract(F.lit("DAY"), c).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), c).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), c).cast("bigint") * 60
    )
    return (whole.cast("decimal(18,6)") + F.extract(F.lit("SECOND"), c)).cast("double")


# -- fallbacks ---------------------------------------------------------------


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def first_nonzero(*cols: Column) -> Column:
    """First value that is neither null nor zero; the last one is taken as it is."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols[:-1]], cols[-1])


def event_label(event: Column, meeting: Column, country: Column, round_number: Column) -> Column:
    numbered = F.concat(F.lit("Round "), round_number.cast("string"))
    return F.coalesce(first_filled(event, meeting, country), numbered)


def event_key(year: Column, round_number: Column) -> Column:
    return (year * 100 + round_number).cast("int")


def session_label(name: Column) -> Column:
    return F.try_element_at(_literal_map(SESSION_LABELS), name)


def points_for(position: Column) -> Column:
    """Points of a position: null when it scores no row at all, 0 below first place."""
    place = position.cast("int")
    return F.when(place <= max(POINTS), F.coalesce(F.try_element_at(_literal_map(POINTS), place), F.lit(0)))


def status_word(c: Column) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(STATUS_WORDS), lowered), F.nullif(lowered, F.lit("")), F.lit("queued"))


def version_label(round_number: Column) -> Column:
    return F.when(round_number <= 1, F.lit("V1")).otherwise(F.concat(F.lit("V"), round_number.cast("string")))


# -- text --------------------------------------------------------------------


def normalise(c: Column) -> Column:
    return F.trim(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def short_id(c: Column) -> Column:
    """First eight characters, as shown in lists."""
    return F.substring(c, 1, 8)


def title_of(path: Column) -> Column:
    """File name without folder and extension, dashes as spaces."""
    return F.replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("-"), F.lit(" "))


def text_list(text: Column) -> Column:
    """Comma-separated items, trimmed, empties removed."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def year_list(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(text_list(text), lambda x: x.cast("int"))))


def seasons(setting: Column, target_year: Column) -> Column:
    """Training seasons: an explicit list, or the target year and the two before it for ``auto`` or ``default``."""
    recent = F.sequence(target_year - 2, target_year)
    explicit = F.transform(text_list(setting), lambda x: x.cast("int"))
    return F.when(F.lower(setting).isin("auto", "default"), recent).otherwise(explicit)


# -- parameters in JSON ------------------------------------------------------


def param_string(config: Column, key: str, default: str | None = "") -> Column:
    return F.coalesce(F.get_json_object(config, f"$.{key}"), F.lit(default))


def param_int(config: Column, key: str, default: int | None = 0) -> Column:
    """Integer parameter: numbers are truncated, texts give their leading integer.

    A parameter that is absent takes the default; one that is present but not
    a number stays null, the case in which a request is rejected.
    """
    text = F.get_json_object(config, f"$.{key}")
    value = F.try_variant_get(F.try_parse_json(config), f"$.{key}", "variant")
    whole = F.when(F.schema_of_variant(value) != "STRING", text.try_cast("double").try_cast("bigint"))
    return F.when(text.isNull(), F.lit(default).cast("bigint")).otherwise(F.coalesce(whole, leading_int(text)))


def param_bool(config: Column, key: str, default: bool = False) -> Column:
    """Boolean parameter; anything but a JSON boolean takes the default."""
    document = F.try_parse_json(config)
    value = F.try_variant_get(document, f"$.{key}", "variant")
    strict = F.schema_of_variant(value) == "BOOLEAN"
    return F.when(strict, F.try_variant_get(document, f"$.{key}", "boolean")).otherwise(F.lit(default))


def form_int(text: Column) -> Column:
    return F.coalesce(leading_int(text), F.lit(0).cast("bigint"))


def form_bool(text: Column) -> Column:
    return F.lower(text) == "true"


def fingerprint(params: Column) -> Column:
    """md5 of ``k=v`` pairs joined by ``&`` in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.md5(F.array_join(pairs, "&"))


# -- result rows -------------------------------------------------------------


def display_label(*candidates: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in candidates], F.lit("Item"))


def json_text(value: Column) -> Column:
    """A variant as text: scalars as they are, arrays and objects as JSON."""
    kind = F.schema_of_variant(value)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(nested, F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))

"""Column functions on names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATORS = ("return", "break", "continue")
DISPLAY_LIMIT = 96


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace of every kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def compact(col: Column) -> Column:
    """Whitespace runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def compact_label(col: Column, limit: int | None = None) -> Column:
    """Compact text without one trailing ``;``; with ``limit`` cut it for display."""
    text = compact(F.regexp_replace(strip(col), ";$", ""))
    if limit is None:
        return text
    cut = F.concat(F.substring(text, 1, limit - 1), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def first_word(label: Column) -> Column:
    return F.regexp_extract(label, r"^\s*([^\s(]*)", 1)


def is_terminator(label: Column) -> Column:
    return first_word(label).isin(*TERMINATORS)


def function_container(name: Column) -> Column:
    """Text before the last ``.``, else before the last ``:``, else null."""
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.", 1)).when(
        name.contains(":"), F.regexp_extract(name, r"^(.*):", 1)
    )

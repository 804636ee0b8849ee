"""Text expressions for name columns and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the greeting of the name reports.
GREETING = "Hola, %s! Bienvenido de"


def has_uppercase(column: Column) -> Column:
    """True if the value holds an ASCII capital; null counts as no."""
    return F.coalesce(column.rlike("[A-Z]"), F.lit(False))


def greeting(name: Column) -> Column:
    """Greeting for a name; null stays null."""
    return F.when(name.isNotNull(), F.format_string(GREETING, name))


def split_genres(genres: Column) -> Column:
    """``Comedy|Drama`` as an array."""
    return F.split(genres, "[|]")


def ten_decimals(value: Column) -> Column:
    """Fixed ten decimals, the number format of the text reports."""
    return F.format_string("%.10f", value)

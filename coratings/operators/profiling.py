"""Counts and greetings over a column of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coratings.functions.text import greeting, has_uppercase


def count_uppercase(df: DataFrame, column: str, by: str | list[str] | None = None) -> DataFrame:
    """How many values of ``column`` hold an ASCII capital, per group if asked."""
    groups = [] if by is None else [by] if isinstance(by, str) else list(by)
    counted = F.count_if(has_uppercase(F.col(column))).alias("n_uppercase")
    return df.groupBy(*groups).agg(counted)


def greet(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a ``greeting`` for each name."""
    return df.withColumn("greeting", greeting(F.col(column)))

"""Aggregates that keep an order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(value: Column, *order: Column) -> Column:
    """The values in the order of ``order``; ties by value."""
    rows = F.sort_array(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def ordered_text(value: Column, separator: str, *order: Column) -> Column:
    return F.array_join(ordered_list(value, *order), separator)


def ordered_distinct(value: Column, *order: Column) -> Column:
    """Each value once, where it came first."""
    return F.array_distinct(ordered_list(value, *order))


def sorted_set(value: Column) -> Column:
    """Each value once, sorted: an order for what has none."""
    return F.sort_array(F.collect_set(value))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)

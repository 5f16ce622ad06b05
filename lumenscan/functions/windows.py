"""Ordered windows over the rows of a file, built when a plan is (they need a session)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Ordered(NamedTuple):
    """One partitioning and order: the plain window, and its two running frames."""

    all: WindowSpec
    to: WindowSpec  # up to and including the current row
    before: WindowSpec  # without the current row


def ordered(keys: list, order: list) -> Ordered:
    window = W.partitionBy(*keys).orderBy(*order)
    frames = (window.rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    return Ordered(window, *frames)


def latest(value: Column, when: Column, window: WindowSpec) -> Column:
    """The newest ``value`` among the window's rows that satisfy ``when``."""
    return F.last(F.when(when, value), ignorenulls=True).over(window)


def set_aside(rows: DataFrame, names: list[str], name: str) -> DataFrame:
    """``rows`` with the columns ``names`` as one struct: a pass that only hands them on copies it whole, not by field."""
    return rows.withColumn(name, F.struct(*names)).drop(*names)


def taken_back(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the columns of the struct ``name`` again."""
    return rows.select("*", f"{name}.*").drop(name)

"""Structural elements: functions, local functions, locals and type aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.batches import elements as batch
from lumenscan.operators.lexing import derived

ELEMENT_KINDS = ("import", "type_alias", "constant", "variable", "function", "local_function")


def elements(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Elements in file order with position, dotted container and signature.

    The inside of a local function, and of a function bound by ``local``, is not listed.
    """
    return derived(units, partitions, batch.elements_of, batch.SCHEMA)


def elements_of_kind(units: DataFrame, *kinds: str, partitions: int | None = None) -> DataFrame:
    return elements(units, partitions).filter(F.col("kind").isin(*kinds))

"""The place of each row in the order of the input, found without one task that sees all rows.

Rows are dealt to ranges of the order, sorted and numbered there, and written; the totals of the
ranges, a row for each task, are added up to give every range the number it starts at.  Numbers
are written before they are used, so a lost task cannot number rows anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenscan.session import write_stage

# ``monotonically_increasing_id`` holds the task above this many bits and the row in it below.
_ROW_BITS = 33


def with_ordinal(df: DataFrame, *by: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """``df`` with its places from 0 in the order of ``by``; nulls come first, and equal rows in any order.

    Rows equal in ``by`` share a task, so ``by`` should end with a key.  Other columns stay; an empty
    table stays empty.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())
    placed = write_stage(placed, "placed")
    shard = F.shiftright(name, _ROW_BITS)
    totals = placed.groupBy(shard.alias("_shard")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    row = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rows = placed.withColumn("_shard", shard).join(starts, "_shard")
    return rows.withColumn(name, F.col("_start") + row).select(*df.columns, name)

"""All pairs inside groups of any size: large groups are cut into blocks, and every two blocks meet in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, group: str, size: Column, item: str, tile: int, own: bool = False) -> DataFrame:
    """``rows`` with tile_at (what to group them by), tile_group, tile_mine, tile_low and tile_high for ``pieces``.

    A group of ``size`` rows is dealt by a hash of ``item`` into blocks of about ``tile`` rows. A
    row goes to the pair of its block with each block, or with ``own`` to its own block alone.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(size / F.lit(tile)).cast("int")
    placed = rows.withColumns({"tile_blocks": blocks, "tile_mine": F.pmod(F.xxhash64(item), blocks).cast("int")})
    others = F.array(F.col("tile_mine")) if own else F.sequence(F.lit(0), F.col("tile_blocks") - 1)
    met = placed.withColumn("tile_other", F.explode(others))
    low, high = F.least("tile_mine", "tile_other"), F.greatest("tile_mine", "tile_other")
    few = F.pmod(F.xxhash64(group), F.lit(n * 8))
    at = F.when(F.col("tile_blocks") == 1, few).otherwise(F.xxhash64(group, low, high))
    named = met.withColumns({"tile_at": at, "tile_group": F.col(group), "tile_low": low, "tile_high": high})
    return named.drop("tile_blocks", "tile_other")


def pieces(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The places of both blocks of each tile, and whether they are the same block."""
    group, mine, low, high = (np.asarray(rows.column(c).combine_chunks()) for c in ("tile_group", "tile_mine", "tile_low", "tile_high"))
    order = np.lexsort((high, low, group))
    changes = (np.diff(group[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    for at in np.split(order, np.flatnonzero(changes) + 1):
        if low[at[0]] == high[at[0]]:
            yield at, at, True
        else:
            yield at[mine[at] == low[at]], at[mine[at] == high[at]], False

"""Vectors of whole numbers, packed in few bytes, and exact products of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.session import write_stage

#: Whole components are held to this; scores and errors are held to the range of a long.
MOST, LONG = 2.0**62, 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: float = 256.0, **keep: Column) -> DataFrame:
    """``keep``, rid (a number of its own for each row) and codes (floor(scale * x) of every component x), written once.

    Rows whose ``embedding`` is null or holds a null or a component that is not finite are left out.
    """
    fields = vectors.select(*[c.alias(name) for name, c in keep.items()], "embedding")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.schema if f.name != "embedding")
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            fine = np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - sizes])
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * np.where(np.isfinite(values), values, 0)), -MOST, MOST).astype(np.int64)
            kept = np.flatnonzero(fine)
            codes = [packed(whole[a:b]) for a, b in zip((ends - sizes)[kept], ends[kept])]
            columns = [batch.column(name).take(pa.array(kept)) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.binary())], names=[*names, "codes"])

    rows = fields.mapInArrow(run, f"{schema}, codes binary")
    return write_stage(rows.withColumn("rid", F.monotonically_increasing_id()), "whole-vectors")


def packed(whole: np.ndarray) -> bytes:
    """Little-endian bytes, two a number where all fit and eight otherwise, behind one byte that says which."""
    small = not len(whole) or (int(whole.min()) >= -(1 << 15) and int(whole.max()) < 1 << 15)
    return (b"\2" if small else b"\10") + whole.astype("<i2" if small else "<i8").tobytes()


def dimension(codes: bytes) -> int:
    return (len(codes) - 1) // codes[0]


def unpacked(codes: list[bytes], width: int) -> np.ndarray:
    """A row for each of ``codes``, filled with zeros to ``width``."""
    out = np.zeros((len(codes), width), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, code in enumerate(codes):
        kinds.setdefault((code[0], len(code)), []).append(i)
    for (size, length), rows in kinds.items():
        values = np.frombuffer(b"".join([codes[i][1:] for i in rows]), f"<i{size}")
        out[rows, : (length - 1) // size] = values.reshape(len(rows), -1)
    return out


def largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def products(left: np.ndarray, right: np.ndarray, spare: int = 1) -> np.ndarray:
    """All inner products of the rows of two matrices, exact, in a type that holds them ``spare`` times."""
    most = largest(left) * largest(right) * max(left.shape[1], 1) * spare
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    return left.astype(kind) @ right.astype(kind).T


def to_long(values: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what lies beyond them is the nearest one."""
    return np.array([min(max(int(v), -LONG - 1), LONG) for v in values], np.int64) if values.dtype == object else values.astype(np.int64)

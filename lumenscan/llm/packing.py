"""Packing: concatenate all documents and cut the stream into windows of equal length."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.llm.encoding import encoder
from lumenscan.llm.tables import by_bytes, id_and_text, releasing
from lumenscan.session import work_dir

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def narrow(ids: np.ndarray) -> bytes:
    """Ids as little-endian bytes, two each if all fit and four otherwise, behind one byte that says which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def encoded(docs: DataFrame, tokenizer: str, kind: str, end_id: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """The ids of each document, written once: doc_id, part, local_start (ids before it in its part), n, ids.

    A part is one task of this job; it is written with its running sums, so later readers may
    split its files in any way.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before = encoder(tokenizer, kind), 0
        for batch in by_bytes(batches, "text", batch_bytes):
            ids, bounds = run.ids(batch.column("text"), end_id)
            stored = [narrow(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column("doc_id"), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(stored, pa.binary())]
            before += int(bounds[-1])
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    spark = docs.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/encoded-{uuid.uuid4().hex}"
    rows = id_and_text(docs).mapInArrow(releasing(encode), "doc_id bigint, local_start bigint, n bigint, ids binary")
    rows.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id bigint, local_start bigint, n bigint, ids binary, part int").parquet(path)


def part_bases(rows: DataFrame) -> DataFrame:
    """part, base: the ids of all parts before it. One row per task of the first pass, so one window is small."""
    totals = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, length: int = 2048) -> DataFrame:
    """Sequences of ``length`` tokens cut from all documents, one after the other.

    Two passes: the first encodes each task's documents, writes them with running sums and so
    gives the totals of the parts; prefix sums over those totals give every document its place
    in one endless stream. The second cuts each document at the multiples of ``length``, in
    place and without a shuffle. A row is one piece, the boundary record of its document in a
    sequence: doc_id, start (ids of its document before it), length, ids (32-bit little-endian),
    doc_tokens (with the end id), sequence_id, offset in the sequence. Only the last sequence can
    be shorter than ``length``.

    A null or empty text is the end id alone, so every row has a piece. Null and repeated
    doc_ids are packed row by row; an empty table gives an empty one; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids", 4 << 20):
            out: list[tuple] = []
            for doc, first, n, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids"))):
                ids, at = widen(stored), 0
                while at < n:
                    place = first + at
                    take = min(n - at, length - place % length)
                    out.append((doc, at, take, ids[at : at + take].tobytes(), n, place // length, place % length))
                    at += take
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    rows = encoded(docs, tokenizer, kind, end_id)
    placed = rows.join(F.broadcast(part_bases(rows)), "part")  # a row per task
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "n", "ids").mapInArrow(cut, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` (unsigned CRC-32 of the ids' bytes) instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

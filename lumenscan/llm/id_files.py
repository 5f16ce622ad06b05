"""Token-id files: Simple-8b blocks of the ids of many documents, in the order of their doc_ids.

A file is a run of blocks, each followed by ``SYNC``. A block holds, little-endian:

    4 s   magic           8 u  part (the file's place)   8 u  block (its place in the file)
    8 u   ids before it in the file
    4 u   pieces, ids, words, escapes
    pieces x (1 u doc_id is not null, 8 s doc_id, 8 u document's place in the file, 4 u ids)
    8 u   words, 8 u escapes, 4 u offsets (ids in front of every GROUP words)
    4 u   CRC-32 of all that

A long document goes on in the next blocks, so a block has a bounded size.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm import simple8b
from lumenscan.llm.encoding import encoder
from lumenscan.llm.packing import part_bases
from lumenscan.llm.tables import by_bytes, id_and_text, partitions, releasing
from lumenscan.session import work_dir, write_stage

MAGIC, SYNC, GROUP, BLOCK_IDS = b"LS8B", b"LS8B-end", 64, 1 << 16
#: Text for each file; a reader holds one file.
FILE_BYTES = 128 << 20
_HEAD = struct.Struct("<4sQQQIIII")
_PIECE = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("place", "<u8"), ("ids", "<u4")])

READ = "part bigint, place bigint, doc_id bigint, local_start bigint, n bigint, ids_crc32 bigint, ids binary"
_READ = pa.schema([
    ("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()),
    ("n", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


def block_bytes(part: int, block: int, before: int, pieces: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes = simple8b.encode(ids)
    offsets = simple8b.group_offsets(words, GROUP)
    head = _HEAD.pack(MAGIC, part, block, before, len(pieces), len(ids), len(words), len(escapes))
    body = b"".join((head, pieces.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), offsets.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, at: int) -> tuple[int, int, int, np.ndarray, np.ndarray, int]:
    """part, block, ids before it, pieces, ids of the block at byte ``at``, and where the next one begins."""
    magic, part, block, before, n_pieces, n_ids, n_words, n_escapes = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError(f"no block at byte {at}")
    sizes = (n_pieces * _PIECE.itemsize, n_words * 8, n_escapes * 8, -(-n_words // GROUP) * 4)
    end = at + _HEAD.size + sum(sizes)
    if struct.unpack_from("<I", data, end)[0] != zlib.crc32(memoryview(data)[at:end]) or data[end + 4 : end + 4 + len(SYNC)] != SYNC:
        raise ValueError(f"the block at byte {at} is damaged")
    at += _HEAD.size
    pieces = np.frombuffer(data, _PIECE, n_pieces, at)
    words = np.frombuffer(data, "<u8", n_words, at + sizes[0])
    escapes = np.frombuffer(data, "<u8", n_escapes, at + sizes[0] + sizes[1])
    return part, block, before, pieces, simple8b.decode(words, escapes, n_ids), end + 4 + len(SYNC)


def write_id_files(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, parts: int | None = None) -> None:
    """Encode all documents and write them to ``path`` in ascending doc_id order (nulls first).

    One range shuffle of the texts puts the documents in order; its tasks encode, pack and write
    one file each, of about FILE_BYTES of text. Equal doc_ids are ordered by their texts' hash, which also spreads them.
    The files are written by Spark, so ``path`` may be in any store that Spark writes to.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part, block, place, before = encoder(tokenizer, kind), None, 0, 0, 0
        for batch in by_bytes(batches, "text", 4 << 20):
            part = batch.column("part")[0].as_py()
            ids, bounds = run.ids(batch.column("text"), end_id)
            doc_ids, out = batch.column("doc_id").to_pylist(), []
            for low in range(0, len(ids), BLOCK_IDS):
                high = min(low + BLOCK_IDS, len(ids))
                first, last = np.searchsorted(bounds, low, side="right") - 1, np.searchsorted(bounds, high, side="left")
                pieces = np.zeros(last - first, _PIECE)
                mine = doc_ids[first:last]
                pieces["known"] = [x is not None for x in mine]
                pieces["doc_id"] = [x or 0 for x in mine]
                pieces["place"] = place + np.arange(first, last)
                pieces["ids"] = np.minimum(bounds[first + 1 : last + 1], high) - np.maximum(bounds[first:last], low)
                out.append(block_bytes(part, block, before + low, pieces, ids[low:high]))
                block += 1
            place += batch.num_rows
            before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = id_and_text(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n = parts or partitions(rows, "text", FILE_BYTES)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    written = placed.mapInArrow(releasing(blocks), "value binary")
    written.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SYNC.decode()).text(path)


def read_id_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files: part, place (in the part), doc_id, local_start, n, ids_crc32, ids.

    The ids are 32-bit little-endian, or null without ``with_ids``; they are decoded either way.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in (x.as_py() for x in batch.column("content")):
                at, held, rows, size = 0, None, [], 0
                while at < len(data):
                    part, _, before, pieces, ids, at = read_block(data, at)
                    ids = ids.astype("<u4")
                    begins = np.cumsum(pieces["ids"], dtype=np.int64) - pieces["ids"]
                    for known, doc, place, n, begin in zip(*(pieces[c].tolist() for c in ("known", "doc_id", "place", "ids")), begins.tolist()):
                        if held and held[1] != place:
                            rows.append(_document(*held, with_ids))
                            held = None
                        if not held:
                            held = [part, place, doc if known else None, before + begin, []]
                        held[4].append(ids[begin : begin + n].tobytes())
                    size += len(ids)
                    if size > 1 << 21:
                        yield _batch(rows)
                        rows, size = [], 0
                if held:
                    rows.append(_document(*held, with_ids))
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(documents, READ)


def _document(part: int, place: int, doc: int | None, start: int, pieces: list[bytes], with_ids: bool) -> tuple:
    ids = b"".join(pieces)
    return part, place, doc, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ)


def id_file_index(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token-id files, read them back and give each document's place in the stream.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. A null
    or empty text is the end id alone. Null doc_ids come first and are kept; repeated ones are
    kept row by row; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_id_files(docs, path, tokenizer, kind, end_id)
    found = write_stage(read_id_files(spark, path, with_ids=False).drop("ids"), "id-index")
    totals = part_bases(found)
    placed = found.join(F.broadcast(totals), "part")  # a row per file
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")

"""Order MinHash: fingerprints whose likeness follows the edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.llm.hashing import WordHashes, mix
from lumenscan.llm.tables import by_bytes, releasing
from lumenscan.session import write_stage

#: How many k-mers times functions are hashed at once.
AT_ONCE = 1 << 18

EDITS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part bigint, tail string, head string"
)
_EDITS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int64()), ("tail", pa.string()), ("head", pa.string()),
])


class OrderMinHash:
    """Signatures of ``functions`` tuples of ``ell`` k-mers of ``k`` words.

    For each hash function the ``ell`` smallest of the k-mers, numbered by their occurrence,
    are taken, put back in the order of the text, and hashed as a tuple. Two texts share a tuple
    if they share those k-mers in the same order, which edits in few places leave alone and
    reordering does not. Fewer words than ``k`` are one k-mer; fewer k-mers than ``ell`` are all
    taken; a text without words has the tuple of no k-mers.
    """

    def __init__(self, k: int = 3, ell: int = 2, functions: int = 64, seed: int = 42):
        self.k, self.ell = k, ell
        draw = np.random.default_rng(seed)
        self.flip = draw.integers(0, 2**63, functions, np.uint64)
        self.times = draw.integers(0, 2**63, functions, np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = WordHashes()

    def _kmers(self, text: str) -> np.ndarray:
        words = text.split()
        hashes = self.words.of(words)
        span = min(self.k, len(words))
        out = np.zeros(len(words) - span + 1 if span else 0, np.uint64)
        for i in range(span):
            out = mix(out + hashes[i : i + len(out)])
        return out

    def signature(self, text: str) -> np.ndarray:
        """One 16-bit tuple hash for each function."""
        kmers = self._kmers(text)
        n, functions = len(kmers), len(self.flip)
        if not n:
            return np.zeros(functions, np.uint16)
        order = np.argsort(kmers, kind="stable")
        ordered = kmers[order]
        begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        number = np.empty(n, np.uint64)
        number[order] = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        items = mix(kmers + number * np.uint64(0x9E3779B97F4A7C15))
        take = min(self.ell, n)
        out = np.empty(functions, np.uint64)
        step = max(1, AT_ONCE // n)
        for low in range(0, functions, step):
            values = (items ^ self.flip[low : low + step, None]) * self.times[low : low + step, None]
            rows, places = np.arange(len(values)), np.empty((len(values), take), np.int64)
            for t in range(take):
                places[:, t] = values.argmin(axis=1)
                values[rows, places[:, t]] = np.uint64(2**64 - 1)
            places.sort(axis=1)
            tuple_hash = np.full(len(values), take, np.uint64)
            for t in range(take):
                tuple_hash = mix(tuple_hash + kmers[places[:, t]])
            out[low : low + step] = tuple_hash
        return (out >> np.uint64(48)).astype(np.uint16)


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples, 0 to 1."""
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """``text`` with the first code points of ``following`` in place of its last third (rounded down)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id and the fingerprint of the whole text (null as empty) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OrderMinHash(**options)
        for batch in batches:
            out = [to_text(hasher.signature(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


def _row(hasher: OrderMinHash, doc: int | None, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = hasher.signature(edited) if edited != text else mine
    sha = hashlib.sha256(edited.encode()).hexdigest()
    return doc, len(text), sha, to_text(mine), to_text(changed), likeness(mine, changed), likeness(mine, theirs)


def edit_fingerprints(docs: DataFrame, **options: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``edited_text``.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next document is the one behind in descending order of doc_id (nulls last; equal ones by
    their texts' hash), for the last the first. One range shuffle puts the documents in order
    and each task reads its run with one document of look-ahead; only the last document of each
    task waits for the first of the next one. A null or empty text has 0 characters and stays
    as it is, as no character of it is replaced. A single document follows itself. An empty
    table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, head = OrderMinHash(**options), None, None
        for batch in by_bytes(batches, "text", 4 << 20):
            part, rows = batch.column("part")[0].as_py(), []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                mine = hasher.signature(text)
                if held:
                    rows.append((*_row(hasher, *held, text, mine), part, None, head))
                    head = None
                else:
                    head = text
                held = (doc, text, mine)
            yield _edits(rows)
        if held:
            yield _edits([(held[0], None, None, None, None, None, None, part, held[1], head)])

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    found = write_stage(placed.mapInArrow(releasing(run), EDITS), "edits")

    # One row per task: its last document and, from the next task that has any, the first one.
    ends = found.filter("tail is not null or head is not null").groupBy("part").agg(
        F.max(F.when(F.col("tail").isNotNull(), F.col("doc_id"))).alias("doc_id"), F.max("tail").alias("text"), F.max("head").alias("head")
    )
    parts = Window.orderBy("part")
    following = F.coalesce(F.lead("part").over(parts), F.first("part").over(parts)).alias("following")
    next_part = ends.select("part", following)
    heads = ends.select(F.col("part").alias("following"), F.col("head").alias("next_text"))
    seams = ends.select("part", "doc_id", "text").join(next_part, "part").join(heads, "following").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OrderMinHash(**options)
        for batch in batches:
            rows = []
            for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))):
                rows.append((*_row(hasher, doc, text, hasher.signature(text), after, hasher.signature(after)), 0, None, None))
            yield _edits(rows)

    both = found.filter("tail is null").unionByName(seams.mapInArrow(releasing(close), EDITS))
    return both.drop("part", "tail", "head")


def _edits(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_EDITS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS)], schema=_EDITS)

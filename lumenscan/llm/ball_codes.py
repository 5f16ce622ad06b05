"""Vector code compression: codebooks of vector parts by ball k-means, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.integers import LONG, largest, to_long, unpacked, whole_vectors
from lumenscan.session import write_stage

#: Rows of a step, and numbers held at a time where points meet all entries.
ROWS, HELD = 1 << 15, 1 << 20
_SUMS = "part int, entry int, position int, n bigint, total decimal(38,0)"


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the first of ties, and the squared distance to it."""
    own, far = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
    step = max(1, HELD // entries.size)
    for at in range(0, len(points), step):
        gaps = points[at : at + step, None, :] - entries[None, :, :]
        squares = (gaps * gaps).sum(axis=2)
        own[at : at + step] = squares.argmin(axis=1)
        far[at : at + step] = squares.min(axis=1)
    return own, far


def ball_step(points: np.ndarray, entries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` from the entries ``own`` that the points had before, and the distances that it took.

    The points of an entry are its ball, and the farthest of them gives the radius. Another entry
    is as near to some point of the ball as its own one only if it is within twice the radius: those
    are the ball's neighbours, in order of their distance. The same holds for a single point and
    twice its own distance. So a point within half the distance to the first neighbour is of the
    stable core and keeps its entry; one in the ring behind it meets the first neighbour, one in
    the next ring the first two, and so on.
    """
    gaps = points - entries[own]
    far = (gaps * gaps).sum(axis=1)
    between = entries[:, None, :] - entries[None, :, :]
    between = (between * between).sum(axis=2)
    best, least, work = own.copy(), far.copy(), len(points)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(len(entries) + 1))
    for entry in np.flatnonzero(np.diff(bounds)):
        ball = order[bounds[entry] : bounds[entry + 1]]
        reach = 4 * far[ball]  # squared: twice the distance
        others = np.flatnonzero((between[entry] <= reach.max()) & (np.arange(len(entries)) != entry))
        others = others[np.argsort(between[entry][others], kind="stable")]
        rings = np.searchsorted(between[entry][others], reach, side="right")
        outward = np.argsort(-rings, kind="stable")  # the outermost ring first
        ball, rings = ball[outward], rings[outward]
        for nth, other in enumerate(others):
            met = ball[: np.searchsorted(-rings, -nth, side="left")]  # points whose ring is beyond this neighbour
            if not len(met):
                break
            gap = points[met] - entries[other]
            square = (gap * gap).sum(axis=1)
            work += len(met)
            nearer = (square < least[met]) | ((square == least[met]) & (other < best[met]))
            best[met[nearer]], least[met[nearer]] = other, square[nearer]
    return best, least, work


def _cut(codes: list[bytes], parts: int, width: int, entries_most: int) -> np.ndarray:
    """The vectors as (part, row, position), in a type in which sums of squares are exact."""
    whole = unpacked(codes, parts * width)
    most = 2 * max(largest(whole), entries_most)
    if most * most * parts * width >= 1 << 62:
        whole = whole.astype(object)
    return whole.reshape(len(codes), parts, width).transpose(1, 0, 2)


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to ROWS rows, so that balls are worth their while."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _assigned(rows: DataFrame, books: np.ndarray, keep: list[str], first: bool) -> DataFrame:
    """``keep``, codes, assigned (the entry of each part, a byte each) and error, of every row."""
    parts, _, width = books.shape
    most = largest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches):
            points = _cut(table.column("codes").to_pylist(), parts, width, most)
            before = None if first else np.frombuffer(b"".join(table.column("assigned").to_pylist()), np.uint8).reshape(-1, parts)
            own, error = np.zeros((table.num_rows, parts), np.uint8), 0
            for part in range(parts):
                book = books[part].astype(points.dtype)
                if first:
                    mine, far = nearest(points[part], book)
                else:
                    mine, far, _ = ball_step(points[part], book, before[:, part].astype(np.int64))
                own[:, part] = mine
                error = error + far
            columns = [table.column(c).combine_chunks() for c in (*keep, "codes")]
            columns += [pa.array([r.tobytes() for r in own], pa.binary()), pa.array(to_long(error))]
            yield from pa.Table.from_arrays(columns, names=[*keep, "codes", "assigned", "error"]).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep)
    columns = [*keep, "codes"] if first else [*keep, "codes", "assigned"]
    return rows.select(*columns).mapInArrow(run, f"{schema}, codes binary, assigned binary, error bigint")


def _moved(assigned: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the mean of its parts, rounded down; unused entries stay.

    A task adds up its own rows, so a row per entry and position leaves it; the sums are exact.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for table in _batched(batches):
            points = _cut(table.column("codes").to_pylist(), parts, width, 0)
            own = np.frombuffer(b"".join(table.column("assigned").to_pylist()), np.uint8).reshape(-1, parts)
            for part in range(parts):
                order = np.argsort(own[:, part], kind="stable")
                bounds = np.searchsorted(own[order, part], np.arange(entries + 1))
                some = np.flatnonzero(np.diff(bounds))
                n[part] += np.diff(bounds)
                sums[part, some] += np.add.reduceat(points[part][order], bounds[some], axis=0).astype(object)
        rows = [(p, e, i, int(n[p, e]), Decimal(int(sums[p, e, i]))) for p, e in np.argwhere(n).tolist() for i in range(width)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        if rows:
            names = ["part", "entry", "position", "n", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    sums = assigned.select("codes", "assigned").mapInArrow(run, _SUMS)
    total = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for part, entry, position, n, total in total.collect():  # entries times components, however many rows there are
        out[part, entry, position] = int(total) // n
    return out


def _first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, ties by their components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "codes").limit(entries).select("codes").collect()
    whole = unpacked([bytes(r.codes) for r in first], parts * width)
    return whole.reshape(len(first), parts, width).transpose(1, 0, 2)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """A code for every vector, and the codebooks (part, entry, position) that it refers to.

    The table has vec_id, label, assigned (the entry of each part, a byte each) and error (the sum
    over parts of the squared distance to the entry). Components are taken as floor(scale * x).
    ``entries`` is at most 256.

    The codebooks start as the parts of the vectors with the smallest vec_ids. Each round assigns
    every part to the nearest entry and then moves every entry to the mean of its parts; at the end
    parts are assigned again. The first round meets all entries; later ones go on from the entry a
    part had, by ``ball_step``, with the same result as if they had met all. Every round is one
    pass over the written table, without a shuffle of vectors: a task gives the sums of its parts,
    a row per entry and position, and the codebooks, whose size does not depend on the rows, go
    to the next round. Rows of any label or value may be any share of all.

    Vectors that are null or hold null or non-finite components are left out. Vectors are filled
    with zeros to a common length, the next multiple of ``parts`` from the longest. Where there are
    fewer vectors than entries, there are so many entries. Repeated vec_ids are rows of their own,
    a null one counts as the largest. Errors beyond the range of a long are its bound. An empty
    table gives an empty one and no entries; other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code byte tells 256 entries apart")
    rows = whole_vectors(vectors, scale, vec_id=F.col("vec_id").cast("bigint"), label=F.col("label"))
    bytes_each, longest = F.ascii(F.substring("codes", 1, 1)), F.length("codes") - 1
    width = -(-(rows.agg(F.max(F.floor(longest / bytes_each))).first()[0] or 0) // parts) or 1
    books = _first_books(rows, parts, entries, width)
    keep = ["vec_id", "label"]
    if not books.size:
        empty = rows.select(*keep, F.col("codes").alias("assigned"), F.lit(0).cast("bigint").alias("error"))
        return empty, books
    for turn in range(rounds):
        rows = write_stage(_assigned(rows, books, keep, turn == 0), "assigned")
        books = _moved(rows, books)
    return write_stage(_assigned(rows, books, keep, rounds == 0).drop("codes"), "coded"), books


def code_digests(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of what ``compress`` gives.

    ``label_error`` is the sum of the errors of all rows of the label; nulls are one label.
    """
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    rows = coded.withColumns({"key_none": label["none"], "key_name": label["name"]})
    sums = rows.groupBy("key_none", "key_name").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = sums.withColumn("label_error", F.least("total", F.lit(Decimal(LONG))).cast("bigint")).drop("total")
    return rows.join(sums, ["key_none", "key_name"]).select(
        "vec_id", F.lower(F.hex("assigned")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )

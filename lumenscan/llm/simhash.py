"""SimHash near-duplicates, found through deletion-variant signatures of few segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.components import components
from lumenscan.llm.links import spanning
from lumenscan.llm.tables import by_bytes, releasing
from lumenscan.session import write_stage

SEED = 42
#: Groups up to this size are compared pair by pair; larger ones by masks, without pairs.
PAIRWISE = 2048
#: Fingerprints of one key that a task holds; a larger group is linked by masks over the cluster.
HELD = 1 << 17


def fingerprint(text: str, words_each: int = 3) -> int:
    """The 64-bit SimHash of ``text`` over shingles of ``words_each`` words, repeats included.

    Fewer words are one shingle; no words give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(len(words) - words_each + 1, 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-1].tolist()]
    stops = (ends[min(words_each, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, count)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, text_hash (of the text, null as empty), fp (the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            found = np.array([fingerprint(t, words_each) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(releasing(run), "doc_id bigint, text_hash bigint, fp bigint")


def segments_for(distance: int) -> int:
    """The fewest segments of which one must differ by at most one bit: floor(distance / segments) <= 1."""
    return max(1, -(-(distance + 1) // 2))


def _bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def variants(prints: DataFrame, segments: int, *others: str) -> DataFrame:
    """``others``, fp, wild (segment bit left out), rest (the segment without it): one row for each bit of each segment.

    Two fingerprints with a segment that differs in one bit at most share the row of that bit.
    """
    out = []
    for low, high in _bounds(segments):
        mask = (1 << high) - (1 << low)
        for bit in range(low, high):
            kept = mask & ~(1 << bit)
            kept = kept - (1 << 64) if kept >= 1 << 63 else kept
            out.append(F.struct(F.lit(bit).alias("wild"), F.col("fp").bitwiseAND(F.lit(kept)).alias("rest")))
    return prints.select(*others, "fp", F.explode(F.array(*out)).alias("v")).select(*others, "fp", "v.wild", "v.rest")


def _by_masks(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``prints`` that span all pairs within ``distance`` bits, without making the pairs.

    Fingerprints that agree outside ``distance`` positions are within ``distance`` of each other, and two that are
    within it agree outside some such positions; so for each choice of positions equal rests are one linked run.
    Only positions in which the fingerprints differ at all need choosing.
    """
    from itertools import combinations

    spread = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [b for b in range(64) if int(spread) >> b & 1]
    a, b = [], []
    for chosen in combinations(bits, min(distance, len(bits))):
        rest = prints & ~np.uint64(sum(1 << c for c in chosen))
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
        a.append(order[same])
        b.append(order[same + 1])
    return np.concatenate(a), np.concatenate(b)


def _group_links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the sorted, distinct ``prints``: (print, smallest print linked with it)."""
    if len(prints) <= PAIRWISE:
        a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance, 1))
    else:
        a, b = _by_masks(prints, distance)
    root = spanning(len(prints), a, b)
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def _verify(distance: int, held: int):
    """Links of the sorted rows of a task; keys with more than ``held`` fingerprints are passed on as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, hot = None, [], False

        def rows(u, v, is_hot: bool) -> pa.RecordBatch:
            u, v = np.asarray(u, np.uint64).view(np.int64), np.asarray(v, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), is_hot))], names=["u", "v", "hot"])

        def settle() -> Iterator[pa.RecordBatch]:
            prints = np.concatenate(waiting) if waiting else np.zeros(0, np.uint64)
            if hot and len(prints):
                yield rows(prints, prints, True)
            elif len(prints) > 1:
                u, v = _group_links(np.unique(prints), distance)
                if len(u):
                    yield rows(u, v, False)

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            wild, rest = np.asarray(batch.column("wild")), np.asarray(batch.column("rest"))
            cuts = np.flatnonzero((wild[1:] != wild[:-1]) | (rest[1:] != rest[:-1])) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            last = len(begins) - 1
            sizes = ends - begins
            # Inside the batch: pairs at once, larger groups one by one.
            inner = np.flatnonzero(sizes > 1)
            inner = inner[(inner > 0) & (inner < last)]
            two = begins[inner[sizes[inner] == 2]]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            if len(near):
                yield rows(fp[near], fp[near + 1], False)
            for g in inner[sizes[inner] > 2]:
                u, v = _group_links(np.unique(fp[begins[g] : ends[g]]), distance)
                if len(u):
                    yield rows(u, v, False)
            # The first and the last group may go on in the neighbouring batches.
            for g in sorted({0, last}):
                mine = (int(wild[begins[g]]), int(rest[begins[g]]))
                if mine != key:
                    yield from settle()
                    key, waiting, hot = mine, [], False
                waiting.append(fp[begins[g] : ends[g]])
                if hot or sum(map(len, waiting)) > held:
                    prints = np.concatenate(waiting)
                    yield rows(prints, prints, True)
                    waiting, hot = [], True
        yield from settle()

    return run


def links(prints: DataFrame, distance: int = 2, held: int = HELD) -> DataFrame:
    """u, v: links between the distinct fingerprints ``prints`` (fp) with the components of all pairs within ``distance`` bits.

    The fingerprint is cut into the fewest segments of which one must differ by at most one bit
    (two, for up to 3 bits). Every fingerprint is indexed under each segment with each bit left
    out; fingerprints with an equal key are candidates and are verified by all their bits. A key's
    group gives a spanning forest of its links, never its pairs. A group that is too large for a
    task is linked over the cluster by ``hot_links`` instead, which gives the same components.
    """
    keyed = variants(prints, segments_for(distance))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "wild", "rest").sortWithinPartitions("wild", "rest")
    found = write_stage(dealt.mapInArrow(_verify(distance, held), "u bigint, v bigint, hot boolean"), "simhash-links")
    hot = found.filter("hot").select(F.col("u").alias("fp")).distinct()
    return found.filter("not hot").select("u", "v").unionByName(hot_links(hot, distance)).distinct()


def hot_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links that span all pairs within ``distance`` bits of the distinct fingerprints ``prints``.

    Each is keyed by itself without each choice of ``distance`` positions; those with an equal key,
    2 ** distance at most, all link with the smallest of them.
    """
    keyed = prints.select("fp", F.col("fp").alias("rest"), F.lit(-1).alias("last"), F.lit("").alias("at"))
    for _ in range(distance):
        more = keyed.filter("last < 63").select("fp", "rest", "at", F.explode(F.expr("sequence(last + 1, 63)")).alias("last"))
        keyed = more.select("fp", F.expr("rest & ~shiftleft(1L, last)").alias("rest"), "last", F.concat_ws(" ", "at", "last").alias("at"))
    star = keyed.groupBy("at", "rest").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return star.select(F.explode("all").alias("u"), "v").filter("u <> v").distinct()


def simhash_groups(docs: DataFrame, words_each: int = 3, distance: int = 2, held: int = HELD) -> DataFrame:
    """doc_id, text_hash, fp, component_id, for every row of ``docs``.

    Documents link if their fingerprints differ in ``distance`` bits at most; component_id is the
    smallest doc_id that links reach. Equal fingerprints are one node, however many documents
    have them. A null text is the empty one; texts without words have fingerprint 0 and link as
    any others. Repeated rows are kept. A null doc_id is the largest of its component; the
    component of nulls alone is null. An empty table gives an empty one; other columns are ignored.
    """
    found = write_stage(fingerprints(docs, words_each), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), distance, held)).withColumnRenamed("node", "fp")
    member = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = member.join(smallest, "root").select("fp", "component_id")
    return found.join(known, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_fingerprint() -> F.Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def keep_one(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with one of each group of ``simhash_groups``, all columns as they are."""
    return keep_first(docs, simhash_groups(docs, words_each, distance))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of ``found`` (doc_id, text_hash, component_id): that of the smallest doc_id.

    All columns are kept. Of rows that share that doc_id the one with the smallest text hash
    stays, and one of rows that are alike in both.
    """
    groups = write_stage(found.select("doc_id", "text_hash", "component_id"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(
        F.col("first.no_id").alias("lumen_no_id"),
        F.coalesce("first.doc_id", F.lit(0)).alias("lumen_id"),
        F.col("first.text_hash").alias("lumen_hash"),
    )
    columns = docs.columns
    keys = ["lumen_no_id", "lumen_id", "lumen_hash"]  # without nulls, so that one shuffle serves the join and the grouping
    keyed = docs.withColumns({
        "lumen_no_id": F.col("doc_id").isNull(),
        "lumen_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)),
        "lumen_hash": F.xxhash64(F.coalesce("text", F.lit(""))),
    })
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(*columns)

"""Exact top-k search: tiled matrix products, a partial selection in each tile, and a tree of merged lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.integers import dimension, products, to_long, unpacked, whole_vectors
from lumenscan.session import write_stage

#: Rows of a shard, at least and at most, and the most queries of a block.
LEAST_ROWS, MOST_ROWS, BLOCK = 2048, 1 << 16, 4096
#: Queries multiplied with a shard at a time, and lists that one step of the tree merges.
STEP, FAN = 128, 16

LISTS = "block int, node int, query_rid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"
_LISTS = pa.schema([("block", pa.int32()), ("node", pa.int32()), *((c, pa.int64()) for c in ("query_rid", "query_id", "rid", "vec_id", "score"))])


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; a null is the largest, so that it comes last among ties."""
    return rows.column(name).combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _best(scores: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row, the leftmost of ties, without the places ``own``.

    Score and column are folded into one key, so that a partial selection settles ties as well.
    """
    n = scores.shape[1]
    keys = scores * n + np.arange(n - 1, -1, -1)
    keys[own] = (keys.min() if keys.size else 0) - 1
    taken = min(k, n)
    columns = np.argpartition(keys, n - taken, axis=1)[:, n - taken :] if taken < n else np.tile(np.arange(n), (len(keys), 1))
    rows = np.repeat(np.arange(len(keys)), taken)
    hidden = np.zeros(scores.shape, bool)
    hidden[own] = True
    keep = ~hidden[rows, columns.ravel()]
    return rows[keep], columns.ravel()[keep]


def _tile(k: int):
    """The best of one shard for the queries of one block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.lexsort((_numbers(rows, "rid"), _numbers(rows, "vec_id"))))  # ties go to the smaller vec_id
        asks, rid = np.asarray(rows.column("asks")), _numbers(rows, "rid")
        codes = rows.column("codes").to_pylist()
        sizes = np.array([dimension(c) for c in codes])
        found = []
        for size in np.unique(sizes[asks]):
            queries, others = np.flatnonzero(asks & (sizes == size)), np.flatnonzero(~asks & (sizes == size))
            if not len(others):
                continue
            right = unpacked([codes[i] for i in others], size)
            place = {r: i for i, r in enumerate(rid[others].tolist())}
            for at in range(0, len(queries), STEP):
                mine = queries[at : at + STEP]
                scores = products(unpacked([codes[i] for i in mine], size), right, 2 * len(others))
                own = [(i, place[r]) for i, r in enumerate(rid[mine].tolist()) if r in place]
                i, j = _best(scores, tuple(np.array(own, np.int64).reshape(-1, 2).T), k)
                found.append((mine[i], others[j], to_long(scores[i, j])))
        query, other = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
        score = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.int64)
        ids, at = rows.column("vec_id"), pa.array(query)
        columns = [rows.column("block").take(at), rows.column("node").take(at), rid[query], ids.take(at), rid[other], ids.take(pa.array(other)), score]
        return pa.table(columns, schema=_LISTS)

    return run


def _merge(k: int):
    """The best ``k`` of the lists of each query."""

    def run(rows: pa.Table) -> pa.Table:
        query = _numbers(rows, "query_rid")
        rows = rows.take(np.lexsort((_numbers(rows, "rid"), _numbers(rows, "vec_id"), ~_numbers(rows, "score"), query)))
        query = np.sort(query)
        begin = np.searchsorted(query, query)
        return rows.filter(pa.array(np.arange(len(query)) - begin < k)).cast(_LISTS)

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product for every row that satisfies ``asks``.

    Components are taken as floor(scale * x), so products are whole numbers and exact; ties go to
    the smaller vec_id. A query's own row is no candidate.

    Rows are dealt into shards and queries into blocks, and each block meets each shard in one
    tile: a matrix product, of which a partial selection keeps k scores for each query. So a tile
    holds a bounded number of rows and gives a bounded list. The lists of FAN shards are merged at
    a time, level by level, until one is left for each query. Rows are spread by number, so equal
    vectors, and ids in any order, make no shard larger.

    Vectors that are null or hold null or non-finite components neither ask nor are found. Only
    vectors of the same length meet; empty ones score 0 with each other. Repeated vec_ids are rows
    of their own, queries of their own included, which find one another. A null vec_id can be
    found, after all others of its score; ``asks`` decides whether it asks. A score beyond the
    range of a long is its nearest bound. An empty table gives an empty one; other columns are
    ignored.
    """
    rows = whole_vectors(vectors, scale, vec_id=F.col("vec_id").cast("bigint"), asks=F.coalesce(asks, F.lit(False)))
    total, queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = -(-total // min(max(total // tasks, LEAST_ROWS), MOST_ROWS)) or 1
    blocks = -(-queries // BLOCK) or 1
    shard = F.pmod(F.col("rid"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sought = rows.select(every(blocks).alias("block"), shard.alias("node"), F.lit(False).alias("asks"), "rid", "vec_id", "codes")
    asking = rows.filter("asks").select(block.alias("block"), every(shards).alias("node"), "asks", "rid", "vec_id", "codes")
    lists = sought.unionByName(asking).groupBy("block", "node").applyInArrow(_tile(k), LISTS)
    while shards > 1:
        lists = write_stage(lists, "top-lists")
        shards = -(-shards // FAN)
        # A step holds FAN * k rows of a query, so a block of queries may be merged at once.
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("block", "node").applyInArrow(_merge(k), LISTS)
    return _ranked(lists)


def _ranked(lists: DataFrame) -> DataFrame:
    """Ranks from 1 in the ``k`` rows that are left of each query."""
    best = F.struct((-F.col("score").cast("decimal(20,0)")).alias("low"), F.col("vec_id").isNull().alias("no_id"), "vec_id", "rid", "score")
    each = lists.groupBy("query_rid", "query_id").agg(F.array_sort(F.collect_list(best)).alias("best"))
    ranked = each.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")

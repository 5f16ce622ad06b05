"""Near-duplicate vectors by sorted projection passes, and their exact links inside each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.components import components
from lumenscan.llm.links import spanning
from lumenscan.llm.tiles import pieces, tiled
from lumenscan.session import write_stage

#: Blocks per task group; the first block of the next group comes along.
GROUP_BLOCKS = 4
#: Vectors of a component that a task compares with each other, and rows compared at a time.
TILE, STEP = 4096, 512
#: Labels whose sums a task holds before it hands them on.
HELD_LABELS = 1000
_ORDER = ["pass_no", "label", "signature", "rid"]


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: with a label, of finite components, not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & some)


def _shapes(distinct: DataFrame, threshold: float, passes: int, max_passes: int, window: int, miss: float) -> DataFrame:
    """label, dim, mean and passes: the mean unit vector of a label's vectors of one length, and how many passes they need.

    With c the squared length of the mean, unit vectors of the label have c as their mean cosine, and
    a pair at the threshold t lies at a cosine of 1 - (1 - t) / (1 - c) once the mean is taken off.
    That gives the chance that one projection has the same sign for both, and so the chance that the
    pair shares as many first signs as cut the label down to a window (and one more). Passes are as
    many as leave a pair unmet with a chance of ``miss``.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def flushed() -> pa.RecordBatch:
            keys = list(held)
            table = {
                "label": pa.array([k[0] for k in keys], pa.int64()), "dim": pa.array([k[1] for k in keys], pa.int32()),
                "n": pa.array([held[k][0] for k in keys], pa.int64()), "total": pa.array([held[k][1].tolist() for k in keys], pa.list_(pa.float64())),
            }
            held.clear()
            return pa.RecordBatch.from_pydict(table)

        for batch in batches:
            lists, labels = batch.column("embedding").to_pylist(), np.asarray(batch.column("label"))
            sizes = np.array([len(v) for v in lists], np.int64)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                units = _unit([lists[i] for i in mine])
                names, at = np.unique(labels[mine], return_inverse=True)
                totals = np.zeros((len(names), int(dim)))
                np.add.at(totals, at, units)
                for name, n, total in zip(names.tolist(), np.bincount(at).tolist(), totals):
                    one = held.setdefault((name, int(dim)), [0, 0.0])
                    one[0], one[1] = one[0] + n, one[1] + total
            if len(held) > HELD_LABELS:
                yield flushed()
        if held:
            yield flushed()

    parts = distinct.select("label", "embedding").mapInArrow(add, "label bigint, dim int, n bigint, total array<double>")
    # A row for each component, so that many parts of one label add up before they are shuffled.
    sums = parts.select("label", "dim", "n", F.posexplode("total").alias("i", "x"))
    sums = sums.groupBy("label", "dim", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"])
    shapes = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), values.alias("total"))
    mean = F.transform("total", lambda x: x / F.col("n"))
    shapes = shapes.select("label", "dim", "n", mean.alias("mean"))
    narrow = F.least(F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x), F.lit(1 - 1e-9))
    cosine = F.greatest(1 - (1 - threshold) / (1 - narrow), F.lit(0.0))
    agree = 1 - F.acos(cosine) / np.pi
    met = F.pow(agree, F.log2(F.greatest(F.col("n") / window, F.lit(1.0))) + 1)
    needed = F.ceil(F.log(F.lit(miss)) / F.log(F.greatest(1 - met, F.lit(1e-9))))
    most = max(passes, max_passes)
    return write_stage(shapes.select("label", "dim", "mean", F.least(F.greatest(needed, F.lit(passes)), F.lit(most)).cast("int").alias("passes")), "shapes")


def _signatures(distinct: DataFrame, shapes: DataFrame, bits: int, seed: int) -> DataFrame:
    """A row per vector and pass: the signs of ``bits`` random projections, without the label's mean, as one number, first bit highest."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (1 << np.arange(bits)[::-1]).astype(np.int64)
        for batch in batches:
            rid, label, passes = (np.asarray(batch.column(c)) for c in ("rid", "label", "passes"))
            lists, means = batch.column("embedding").to_pylist(), batch.column("mean").to_pylist()
            sizes = np.array([len(v) for v in lists], np.int64)
            for dim, times in {(int(d), int(t)) for d, t in zip(sizes, passes)}:
                mine = np.flatnonzero((sizes == dim) & (passes == times))
                for one in range(times):
                    if (dim, one) not in planes:
                        planes[dim, one] = np.random.default_rng([seed, dim, one]).standard_normal((dim, bits))
                centred = _unit([lists[i] for i in mine]) - np.array([means[i] for i in mine], np.float64)
                signature = np.stack([(centred @ planes[dim, one] > 0) @ weights for one in range(times)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(rid[mine], times)),
                        pa.array(np.repeat(label[mine], times)),
                        pa.array(np.tile(np.arange(times, dtype=np.int32), len(mine))),
                        pa.array(signature.ravel()),
                    ],
                    names=["rid", "label", "pass_no", "signature"],
                )

    # The means are a row for each label; adaptive execution broadcasts them if they are small, and splits hot labels if not.
    rows = distinct.select("rid", "label", "embedding", F.size("embedding").alias("dim")).join(shapes, ["label", "dim"])
    rows = rows.select("rid", "label", "embedding", "mean", "passes")
    return rows.mapInArrow(sign, "rid bigint, label bigint, pass_no int, signature bigint")


def _blocks(signatures: DataFrame, window: int) -> DataFrame:
    """The block of each vector in each pass: runs of ``window`` rows of the sorted order.

    Block numbers rise by one from block to block of a run, and by two where a label, a pass or a
    task ends, so that two blocks are neighbours if and only if their numbers differ by one.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, held = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column("part")[0].as_py() << 32
            out = []
            for key in zip(batch.column("pass_no").to_pylist(), batch.column("label").to_pylist()):
                if key != last:
                    block, held, last = block + 2, 0, key
                elif held == window:
                    block, held = block + 1, 0
                held += 1
                out.append(base + block)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("pass_no"), pa.array(out, pa.int64())], names=["rid", "pass_no", "block"])

    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = signatures.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id().cast("bigint"))
    return placed.select("rid", "label", "pass_no", "part").mapInArrow(number, "rid bigint, pass_no int, block bigint")


def _unit(lists: list[list[float]]) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    vectors = np.array(lists, np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of one group of neighbouring blocks as a spanning forest: (rid, other), other the smallest rid linked with it."""
    rid = np.asarray(rows.column("rid").combine_chunks())
    own, block = np.asarray(rows.column("own")), np.asarray(rows.column("block"))
    lists = rows.column("embedding").to_pylist()
    sizes = np.array([len(v) for v in lists])
    found = []
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        vectors = _unit([lists[i] for i in mine])
        for b in np.unique(block[mine][own[mine]]):
            left, right = np.flatnonzero(block[mine] == b), np.flatnonzero((block[mine] == b) | (block[mine] == b + 1))
            i, j = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
            found.append((mine[left[i]], mine[right[j]]))
    order = np.argsort(rid, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = spanning(len(rid), rank[np.concatenate([x for x, _ in found])], rank[np.concatenate([x for _, x in found])]) if found else np.arange(len(rid))
    other = rid[order][root[rank]]
    some = np.flatnonzero(other != rid)
    return pa.table({"rid": rid[some], "other": other[some]})


def _count(rows: pa.Table, threshold: float) -> pa.Table:
    """(rid, n): the partners of each vector in the tiles of one group."""
    rid, copies = np.asarray(rows.column("rid").combine_chunks()), np.asarray(rows.column("copies"))
    lists, counts = rows.column("embedding").to_pylist(), np.zeros(rows.num_rows, np.int64)
    for left, right, same in pieces(rows):
        if not len(left) or not len(right):
            continue
        a, b = (_unit([lists[i] for i in x]) for x in (left, right))
        for low in range(0, len(left), STEP):
            near = a[low : low + STEP] @ b.T >= threshold
            if same:
                near[np.arange(len(near)), low + np.arange(len(near))] = False
            else:
                counts[right] += copies[left[low : low + STEP]] @ near
            counts[left[low : low + STEP]] += near @ copies[right]
    some = np.flatnonzero(counts)
    return pa.table({"rid": rid[some], "n": counts[some]})


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, passes: int = 12, bits: int = 24, window: int = 1024, seed: int = 42,
    max_passes: int = 96, miss: float = 0.01,
) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of one label are first taken together with their number. In each pass the
    distinct vectors are sorted by label and the signs of ``bits`` random projections of what is left
    of them without the label's mean, cut into
    blocks of ``window`` rows, and compared inside their block and with the next one, in double
    precision. The pairs at or above ``threshold`` of all passes are united into components, in
    work that grows with the rows; a cluster larger than the window is joined through shared
    blocks. ``n_links`` are then counted over all pairs of each component, which no link leaves:
    a component larger than TILE is cut into blocks, of which every two meet in a task. Pairs are
    counted where they are compared, never written. A label has ``passes`` passes, and more, up to
    ``max_passes``, where its size and narrowness would else leave a pair at the threshold unmet with
    a chance above ``miss`` (``_shapes``).

    Vectors of different lengths do not link. A null label, a null, empty or zero vector, and null
    or non-finite components link with nothing (0 links, a component of their own). Repeated
    vec_ids are rows of their own with a common id. A null vec_id is kept, links like others,
    and is the largest id of its component; alone, its component is null. An empty table gives an
    empty one; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    key = F.xxhash64("label", "embedding")
    usable = _usable(rows).select("vec_id", "label", "embedding", key.alias("key"))
    grouped = usable.groupBy("label", "key", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # A number of its own for each distinct vector; its order does not matter.
    distinct = write_stage(grouped.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    shapes = _shapes(distinct, threshold, passes, max_passes, window, miss)
    placed = _blocks(_signatures(distinct, shapes, bits, seed), window)
    each = distinct.select("rid", "embedding").join(placed, "rid")
    group = lambda b: F.floor(b / GROUP_BLOCKS)
    roles = F.array(
        F.struct(group(F.col("block")).alias("at"), F.lit(True).alias("own")),
        F.when(group(F.col("block") - 1) != group(F.col("block")), F.struct(group(F.col("block") - 1).alias("at"), F.lit(False).alias("own"))),
    )
    dealt = each.withColumn("role", F.explode(F.array_compact(roles))).select("rid", "embedding", "pass_no", "block", "role.at", "role.own")
    compared = dealt.groupBy("pass_no", "at").applyInArrow(lambda t: _compare(t, threshold), "rid bigint, other bigint")
    roots = components(compared.select(F.col("rid").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "rid")
    member = distinct.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("size"))
    alike = tiled(member.select("rid", "copies", "embedding", "root").join(sizes, "root"), "root", F.col("size"), "rid", TILE)
    linked = alike.groupBy("tile_at").applyInArrow(lambda t: _count(t, threshold), "rid bigint, n bigint").groupBy("rid").agg(F.sum("n").alias("n"))
    member = member.join(linked, "rid", "left")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = member.join(smallest, "root").select(
        F.col("label").alias("k_label"), F.col("key").alias("k_key"), F.col("embedding").alias("k_embedding"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    keyed = rows.withColumn("key", key)
    same = (F.col("key") == F.col("k_key")) & (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding"))
    out = keyed.join(known, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

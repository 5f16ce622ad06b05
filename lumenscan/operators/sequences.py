"""Sequence operators for any keyed, ordered table.

They are the rules' building blocks: equal neighbours, rows behind a terminator, nesting
depth, rows inside a block, and groups that lack a partner row.

A key may hold a large share of all rows.  ``bucket`` cuts every key along its order: an
expression that never falls as the order rises, such as the day of a timestamp or
``floor(pos / 10000)``.  Windows then run per (key, bucket), and what earlier buckets of a
key hand over comes from a table with one row per bucket.  ``data_buckets`` draws the cut
points of such an expression from the data, for orders of any type.  Without a bucket a key is
one group, which suits keys that are one row of the input, as the tags of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = "_bucket"
# Rows drawn for each cut point of `data_buckets`; a bucket is then off its even share by about a sixth.
DRAWN_PER_CUT = 32


def data_buckets(df: DataFrame, order: list[str], n: int | None = None, seed: int = 0) -> Column:
    """A bucket expression for ``df`` and ``order``: about ``n`` even buckets of all rows, the same for every key.

    A job over the order columns alone draws ``n * DRAWN_PER_CUT`` rows by chance (each task keeps
    no more) and takes ``n - 1`` of them, evenly placed, as cut points.  These only place rows:
    the operators' results are the same for any cut points.  The columns may be of any type that
    can be sorted; nulls come first, as in a window.  ``n`` is by default the session's number of
    shuffle partitions.  Rows with equal orders share a bucket; without rows there is one bucket.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 1:
        raise ValueError(f"buckets must be 1 or more, not {n}")
    names = [f"_{i}" for i in range(len(order))]
    fields = df.select(*order).schema.fields
    drawn = df.select(*[F.col(c).alias(name) for c, name in zip(order, names)]).orderBy(F.rand(seed)).limit(n * DRAWN_PER_CUT)
    drawn = drawn.orderBy(*names).collect()
    cuts = [drawn[i * len(drawn) // n] for i in range(1, n)] if drawn else []
    if not cuts:
        return F.lit(0)
    literal = lambda row: F.struct(*[F.lit(v).cast(f.dataType).alias(name) for v, f, name in zip(row, fields, names)])
    place = F.struct(*[F.col(c).alias(name) for c, name in zip(order, names)])
    return F.size(F.filter(F.array(*map(literal, cuts)), lambda cut: cut <= place))


def _bucketed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Rows dealt by key and bucket, so that one shuffle serves the window, the sums and the join.

    Without it a join on the key alone would let the window run with a whole key in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(BUCKET, bucket).repartition(n, *keys, BUCKET)


def _carried(rows: DataFrame, keys: list[str], per_bucket: list[Column], carries: dict[str, Column]) -> DataFrame:
    """``rows`` with what the earlier buckets of their key amount to.

    ``per_bucket`` aggregates a bucket; ``carries`` are window expressions over those, to be
    read strictly before a bucket.  Keys and buckets may be null.
    """
    buckets = rows.groupBy(*keys, BUCKET).agg(*per_bucket)
    on = [*keys, BUCKET]
    carry = buckets.select(*[F.col(c).alias(f"_to{i}") for i, c in enumerate(on)], *[c.alias(name) for name, c in carries.items()])
    same = [rows[c].eqNullSafe(carry[f"_to{i}"]) for i, c in enumerate(on)]
    return rows.join(carry, same, "left").drop(*[f"_to{i}" for i in range(len(on))])


def _along(keys: list[str], order: list[str], bucket: Column | None):
    window = W.partitionBy(*keys, *([] if bucket is None else [BUCKET])).orderBy(*order)
    return window, window.rowsBetween(W.unboundedPreceding, -1), window.rowsBetween(W.unboundedPreceding, W.currentRow)


def _buckets_of(keys: list[str]):
    window = W.partitionBy(*keys).orderBy(BUCKET)
    return window, window.rowsBetween(W.unboundedPreceding, -1)


def adjacent_duplicates(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column | None = None
) -> DataFrame:
    """Rows whose value equals the value of the row before them in their group."""
    window, _, _ = _along(keys, order, bucket)
    rows = df if bucket is None else _bucketed(df, keys, bucket)
    rows = rows.withColumn("_prev", F.lag(value).over(window))
    previous = F.col("_prev")
    if bucket is not None:
        rows = rows.withColumn("_nth", F.row_number().over(window))
        last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
        rows = _carried(rows, keys, [last], {"_carry": F.lag("_last").over(_buckets_of(keys)[0])})
        previous = F.when(F.col("_nth") == 1, F.col("_carry")["v"]).otherwise(previous)
    return rows.filter(previous == F.col(value)).select(*df.columns)


def after_terminator(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    is_term: Column,
    first_only: bool = True,
    bucket: Column | None = None,
) -> DataFrame:
    """Rows behind the first terminator of their group, or only the row right behind it."""
    window, before, _ = _along(keys, order, bucket)
    rows = df.withColumn("_term", F.coalesce(is_term, F.lit(False)))
    rows = rows if bucket is None else _bucketed(rows, keys, bucket)
    rows = rows.select("*", F.coalesce(F.count_if("_term").over(before), F.lit(0)).alias("_here"), F.lag("_term").over(window).alias("_prev"))
    ended, right_behind = F.col("_here"), F.col("_prev")
    if bucket is not None:
        rows = rows.withColumn("_nth", F.row_number().over(window))
        buckets, earlier = _buckets_of(keys)
        ends = F.count_if("_term").alias("_ends")
        last = F.max_by(F.col("_term"), F.struct(*order)).alias("_last")
        rows = _carried(
            rows, keys, [ends, last], {"_earlier": F.sum("_ends").over(earlier), "_carry": F.lag("_last").over(buckets)}
        )
        ended = ended + F.coalesce("_earlier", F.lit(0))
        right_behind = F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(right_behind)
    wanted = (ended == 1) & F.coalesce(right_behind, F.lit(False)) if first_only else ended >= 1
    return rows.filter(wanted).select(*df.columns)


def nesting_depth(
    df: DataFrame, keys: list[str], order: list[str], delta: Column, bucket: Column | None = None
) -> DataFrame:
    """Add ``depth``: the running sum of ``delta`` up to and including the row."""
    return _running(df, keys, order, delta, bucket).select(*df.columns, "depth")


def _running(df: DataFrame, keys: list[str], order: list[str], delta: Column, bucket: Column | None) -> DataFrame:
    """``nesting_depth`` with the bucket of each row, if there are buckets."""
    _, _, to = _along(keys, order, bucket)
    rows = df.withColumn("_delta", delta.cast("bigint"))
    rows = rows if bucket is None else _bucketed(rows, keys, bucket)
    rows = rows.withColumn("_run", F.sum("_delta").over(to))
    depth = F.col("_run")
    if bucket is not None:
        earlier = _buckets_of(keys)[1]
        rows = _carried(rows, keys, [F.sum("_delta").alias("_sum")], {"_carry": F.sum("_sum").over(earlier)})
        depth = depth + F.coalesce("_carry", F.lit(0))
    return rows.select(*df.columns, *([] if bucket is None else [BUCKET]), depth.alias("depth"))


def inside_block(
    rows: DataFrame,
    blocks: DataFrame,
    keys: list[str],
    pos: str = "pos",
    start: str = "start",
    end: str = "end",
    width: float | None = None,
) -> DataFrame:
    """Add ``n_blocks``: how many blocks ``start < pos <= end`` hold the row.

    Blocks become two events among the rows, so rows and blocks are never paired.  ``width``
    is that of a bucket of positions.
    """
    payload = F.struct(*rows.columns)
    edges = F.array(
        F.struct(F.col(start).alias("_pos"), F.lit(2).alias("_rank"), F.lit(1).alias("_d")),
        F.struct(F.col(end).alias("_pos"), F.lit(3).alias("_rank"), F.lit(-1).alias("_d")),
    )
    none = F.lit(None).cast(rows.select(payload.alias("r")).dtypes[0][1])
    events = (
        rows.select(*keys, F.col(pos).alias("_pos"), F.lit(1).alias("_rank"), F.lit(0).alias("_d"), payload.alias("_row"))
        .unionByName(blocks.select(*keys, F.inline(edges)).withColumn("_row", none))
    )
    bucket = None if width is None else F.floor(F.col("_pos") / width)
    placed = nesting_depth(events, keys, ["_pos", "_rank"], F.col("_d"), bucket)
    return placed.filter(F.col("_row").isNotNull()).select("_row.*", F.col("depth").alias("n_blocks"))


def level_pairs(rows: DataFrame, keys: list[str], pos: str, delta: str, bucket: Column | None = None) -> DataFrame:
    """``keys``, ``start`` and ``end`` of blocks among openers (``delta`` 1) and closers (-1).

    An opener's partner is the next row on its own level, if that closes.  With ``bucket`` a
    bucket is summed up by its net change of level and by its first row on every level.  Merged
    along the buckets of a key, the changes give the level at which each bucket begins, and the
    first rows give an opener that is the last of its level in its bucket the row to look at,
    however many buckets away.  So no task holds a key, nor a level of it.
    """
    placed = _running(rows.select(*keys, pos, delta), keys, [pos], F.col(delta), bucket)
    placed = placed.withColumn("_level", F.col("depth") + F.when(F.col(delta) < 0, 1).otherwise(0))
    row = F.struct(F.col(pos).alias("pos"), F.col(delta).alias("delta"))
    here = [*keys, "_level"] if bucket is None else [*keys, BUCKET, "_level"]
    placed = placed.withColumn("_next", F.lead(row).over(W.partitionBy(*here).orderBy(pos)))
    if bucket is not None:
        level = [*keys, "_level"]
        first = F.min_by(row, F.col(pos)).alias("_first")
        placed = _carried(placed, level, [first], {"_carry": F.lead("_first").over(_buckets_of(level)[0])})
        placed = placed.withColumn("_next", F.coalesce("_next", "_carry"))
    pair = placed.filter((F.col(delta) > 0) & (F.col("_next")["delta"] < 0))
    return pair.select(*keys, F.col(pos).alias("start"), F.col("_next")["pos"].alias("end"))


def group_missing_partner(df: DataFrame, keys: list[str], has: Column, lacks: Column) -> DataFrame:
    """Keys with a row that satisfies ``has`` and none that satisfies ``lacks``."""
    flags = df.groupBy(*keys).agg(
        F.bool_or(F.coalesce(has, F.lit(False))).alias("_has"), F.bool_or(F.coalesce(lacks, F.lit(False))).alias("_lacks")
    )
    return flags.filter(F.col("_has") & ~F.col("_lacks")).select(*keys)


def bucketed_rule_summary(df: DataFrame, keys: list[str], label: str, buckets: list[str]) -> DataFrame:
    """Per key, one count per bucket of ``label``; zeros kept."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(label) == b).alias(b) for b in buckets])


# ---- rows to run them on --------------------------------------------------------------

# Tags that never close (fixed values).
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)
_NO_TAGS = r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of each document; the texts are partitioned before they are cut."""
    lines = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return documents.select("doc_id", "text").repartition("doc_id").select("doc_id", lines)


def page_tags(pages: DataFrame) -> DataFrame:
    """Opening and closing tags of each page in order, scripts, styles and comments aside.

    The pages are partitioned before they are cut, so windows over a page find its tags in place.
    """
    pages = pages.select("page_id", "html").repartition("page_id")
    clean = F.regexp_replace(F.lower("html"), _NO_TAGS, "")
    tags = F.regexp_extract_all(clean, F.lit("</?[a-z][a-z0-9]*"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "raw"))
    closes = F.col("raw").startswith("</")
    name = F.regexp_replace("raw", "^</?", "")
    delta = F.when(name.isin(*VOID_TAGS), 0).when(closes, -1).otherwise(1)
    return rows.select("page_id", "pos", name.alias("tag"), delta.alias("delta"))

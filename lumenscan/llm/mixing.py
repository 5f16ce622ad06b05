"""Mixing sources to target weights: temperature exponents, and budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.session import write_stage

#: Halvings that one job decides, and jobs.
LEVELS, JOBS = 5, 8
#: Tokens of a block, and the most blocks of a source; the blocks of a source are its sorting grid.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 1 << 16


def word_count(text: Column) -> Column:
    """The number of words between ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("bigint")


def row_key(seed: int = 42) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _measured(docs: DataFrame, tokens: Column, key: Column) -> DataFrame:
    """The row itself (mix_row), mix_source, mix_tokens and mix_key."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("mix_row"), F.col("source").alias("mix_source"), tokens.alias("mix_tokens"), key.alias("mix_key"))


def _unit(epoch: Column) -> Column:
    """A number of [0, 1) that stands for the row's place in the permutation of an epoch."""
    return F.shiftrightunsigned(F.xxhash64("mix_key", epoch.cast("int")), 11) / F.lit(float(2**53))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Of every exponent a: the sum of p ** a and of p ** a * ln p over all sources."""
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.ln("p")).alias(f"l{i}")]
    row = shares.agg(*columns).first()
    return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(exponents))]


def _bisect(shares: DataFrame, low: float, high: float, holds) -> float:
    """The largest exponent of [low, high] at which ``holds(a, z, l)``, which is true up to some point.

    A job sums the powers of all the exponents that LEVELS halvings may meet.
    """
    for _ in range(JOBS):
        steps = 2**LEVELS
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        good = [holds(a, *s) for a, s in zip(grid, _sums(shares, grid))]
        if all(good):
            return high
        if not good[0]:
            return low
        a, b = 0, steps
        while b - a > 1:
            a, b = ((a + b) // 2, b) if good[(a + b) // 2] else (a, (a + b) // 2)
        low, high = grid[a], grid[b]
    return low


def temperature(shares: DataFrame, entropy: float | None, max_repeats: float | None) -> float:
    """The exponent of the shares ``p``: 1 leaves them, 0 makes sources equal.

    ``entropy`` is the least entropy of the weights as a part of that of equal ones; the
    exponent is the largest that reaches it. ``max_repeats`` limits how often the most repeated
    source is read for one reading of the least repeated one; the exponent is raised until it holds.
    """
    n, least, most = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()
    exponent = 1.0 if entropy is not None or not n else 0.0
    if not n or least == most:
        return exponent
    if entropy is not None:
        exponent = _bisect(shares, 0.0, 1.0, lambda a, z, l: math.log(z) - a * l / z >= entropy * math.log(n))  # noqa: E741
    if max_repeats is not None:
        # Weights over shares are p ** (a - 1) / z: largest for the smallest source.
        too_often = lambda a, *_: (least / most) ** (a - 1) > max_repeats
        exponent = max(exponent, _bisect(shares, 0.0, 1.0, too_often) if max_repeats > 1 else 1.0)
    return exponent


def mixing_plan(
    rows: DataFrame, entropy: float | None, max_repeats: float | None, budget: int | None
) -> DataFrame:
    """A row per source: mix_source, tokens, weight, repeats (readings of the source, a real number), blocks.

    ``rows`` have mix_source and mix_tokens. Without a ``budget`` of tokens it is the smallest with
    which every source is read once at least. A source without tokens is read once.
    """
    sources = write_stage(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens")), "sources")
    some = sources.filter("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0] or 0
    shares = some.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    exponent = temperature(shares.select("p"), entropy, max_repeats)
    ((z, _),) = _sums(shares, [exponent])
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent)) / F.lit(z or 1.0)
    planned = sources.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(0.0))
    ratio = F.col("weight") / (F.col("tokens") / F.lit(float(total or 1)))
    if budget is None:
        least = planned.filter("tokens > 0").agg(F.min(ratio)).first()[0] or 1.0
        repeats = ratio / F.lit(least)
    else:
        repeats = F.lit(float(budget)) * F.col("weight") / F.col("tokens")
    # Rounding must not make a whole reading a little more or less.
    repeats = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    blocks = F.least(F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)), F.lit(MOST_BLOCKS))
    planned = planned.withColumns({"repeats": F.when(F.col("tokens") > 0, repeats).otherwise(1.0), "blocks": blocks})
    return write_stage(planned, "mixing-plan")


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_source, cut: rows whose place in the last, partial epoch is below ``cut`` fit the budget.

    The tokens of each block of that epoch are summed where the rows are; prefix sums over the
    blocks of a source find the block in which its budget ends, and only that block is sorted.
    """
    partial = plan.select("mix_source", F.floor("repeats").alias("whole"), (F.col("tokens") * (F.col("repeats") - F.floor("repeats"))).alias("rest"), "blocks")
    partial = partial.filter("rest > 0")
    null_safe = rows["mix_source"].eqNullSafe(partial["mix_source"])
    last = rows.join(partial, null_safe).select(rows["mix_source"], "mix_tokens", _unit(F.col("whole")).alias("unit"), "rest", "blocks")
    last = last.withColumn("block", F.floor(F.col("unit") * F.col("blocks")))
    sums = last.groupBy("mix_source", "rest", "block").agg(F.sum("mix_tokens").alias("tokens"))
    before = Window.partitionBy("mix_source").orderBy("block")
    sums = sums.withColumn("upto", F.sum("tokens").over(before))
    ends = sums.filter("upto > rest").groupBy("mix_source").agg(F.min(F.struct("block", (F.col("upto") - F.col("tokens")).alias("held"))).alias("end"))
    ends = ends.select(F.col("mix_source").alias("end_source"), "end.block", "end.held")
    edge = last.join(ends, last["mix_source"].eqNullSafe(ends["end_source"]) & (last["block"] == ends["block"]))
    edge = edge.select("mix_source", "unit", "mix_tokens", "rest", "held")
    ordered = Window.partitionBy("mix_source").orderBy("unit")
    over = edge.withColumn("upto", F.col("held") + F.sum("mix_tokens").over(ordered)).filter("upto > rest")
    return over.groupBy("mix_source").agg(F.min("unit").alias("cut"))


def mixed_rows(
    docs: DataFrame,
    entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: int = 42,
    key: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` (mix_row), repeated or left out so that sources get their weights.

    Shares of tokens (``tokens`` of a row, else its words) are raised to an exponent found by
    bisection and normalised (see ``temperature``); the weights times the budget say how often
    each source is read (see ``mixing_plan``). Every epoch is a permutation of the source in
    blocks; the last one ends with the row before the budget would be passed.

    Besides mix_row there are mix_epoch, mix_tokens, mix_block and mix_order: sorted by
    mix_order, every stretch holds the sources in their weights. No row is shuffled to be
    chosen: only sums per source and block, and one block per source, are. A source may thus
    hold any part of the rows.

    ``key`` stands for a row where it is placed (see ``row_key``, which reads the text).

    A null source is a source. A null text has 0 tokens; it is chosen with its epoch as any
    other. Rows alike in id and text are chosen together. An empty table gives an empty one.
    """
    measured = _measured(docs, tokens if tokens is not None else word_count(F.col("text")), row_key(seed) if key is None else key)
    rows = write_stage(measured.select("mix_source", "mix_tokens", "mix_key"), "mix-rows")
    plan = mixing_plan(rows, entropy, max_repeats, budget)
    cuts = _cuts(rows, plan).select(F.col("mix_source").alias("cut_source"), "cut")
    joined = plan.join(cuts, plan["mix_source"].eqNullSafe(cuts["cut_source"]), "left")
    reads = write_stage(joined.select(F.col("mix_source").alias("plan_source"), "repeats", "blocks", F.coalesce("cut", F.lit(1.0)).alias("cut")), "mix-reads")
    chosen = measured.join(reads.filter("repeats > 0"), measured["mix_source"].eqNullSafe(reads["plan_source"]))
    chosen = chosen.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1)))
    chosen = chosen.withColumn("mix_unit", _unit(F.col("mix_epoch")))
    fits = (F.col("mix_epoch") + 1 <= F.col("repeats")) | (F.col("mix_unit") < F.col("cut"))
    return chosen.filter(fits).select(
        "mix_row",
        "mix_epoch",
        "mix_tokens",
        F.floor(F.col("mix_unit") * F.col("blocks")).alias("mix_block"),
        ((F.col("mix_epoch") + F.col("mix_unit")) / F.col("repeats")).alias("mix_order"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``mixed_rows`` with the columns of ``docs`` side by side; its own names win over equal ones there."""
    mixed = mixed_rows(docs, **options)
    own = [c for c in mixed.columns if c != "mix_row"]
    return mixed.select(*[F.col(f"mix_row.`{c}`") for c in docs.columns if c.lower() not in own], *own)


def in_mix_order(docs: DataFrame, parts: int, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs`` alone, range-partitioned and sorted by mix_order."""
    mixed = mixed_rows(docs, **options)
    ordered = mixed.repartitionByRange(parts, "mix_order").sortWithinPartitions("mix_order")
    return ordered.select("mix_row.*")

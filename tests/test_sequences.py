"""Sequence operators against brute force, with and without large keys."""

import random

import pytest
from pyspark.sql import functions as F

from lumenscan.operators import sequences as sq


@pytest.fixture(scope="module")
def events():
    """One key holds a third of all rows."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        rows.append((key, i, rng.choice("abbbc"), rng.choice((-1, 0, 1))))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "key int, pos int, value string, delta int").cache()


def groups(events):
    out = {}
    for row in sorted(events):
        out.setdefault(row[0], []).append(row)
    return out


WIDTHS = [None, 40, 1]


def bucket(width):
    return None if width is None else F.floor(F.col("pos") / width)


@pytest.mark.parametrize("width", WIDTHS)
def test_adjacent_duplicates(frame, events, width):
    want = [b[:2] for g in groups(events).values() for a, b in zip(g, g[1:]) if a[2] == b[2]]
    got = sq.adjacent_duplicates(frame, ["key"], ["pos"], "value", bucket=bucket(width)).collect()
    assert sorted((r["key"], r["pos"]) for r in got) == sorted(want)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("first_only", [True, False])
def test_after_terminator(frame, events, width, first_only):
    want = []
    for g in groups(events).values():
        ends = [i for i, r in enumerate(g) if r[2] == "c"]
        if ends:
            behind = g[ends[0] + 1 :]
            want += [r[:2] for r in (behind[:1] if first_only else behind)]
    got = sq.after_terminator(frame, ["key"], ["pos"], F.col("value") == "c", first_only, bucket=bucket(width)).collect()
    assert sorted((r["key"], r["pos"]) for r in got) == sorted(want)


@pytest.mark.parametrize("width", WIDTHS)
def test_nesting_depth(frame, events, width):
    want = []
    for g in groups(events).values():
        depth = 0
        for r in g:
            depth += r[3]
            want.append((r[0], r[1], depth))
    got = sq.nesting_depth(frame, ["key"], ["pos"], F.col("delta"), bucket=bucket(width)).collect()
    assert sorted((r["key"], r["pos"], r["depth"]) for r in got) == sorted(want)


@pytest.mark.parametrize("width", WIDTHS)
def test_inside_block(spark, frame, events, width):
    blocks = [(0, 100, 400), (0, 300, 500), (5, 0, 800), (7, 10, 10)]
    table = spark.createDataFrame(blocks, "key int, start int, end int")
    got = sq.inside_block(frame, table, ["key"], width=width).collect()
    want = sorted((k, p, sum(b[0] == k and b[1] < p <= b[2] for b in blocks)) for k, p, _, _ in events)
    assert sorted((r["key"], r["pos"], r["n_blocks"]) for r in got) == want


def test_a_large_key_is_many_window_tasks(spark, frame):
    plan = spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("pos"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = sq.nesting_depth(plan.withColumn("d", F.lit(1)), ["key"], ["pos"], F.col("d"), F.floor(F.col("pos") / 100))
        rows = sq._bucketed(plan, ["key"], F.floor(F.col("pos") / 100)).filter("key = 0").groupBy(F.spark_partition_id()).count().collect()
        # The window runs on the exchange by key and bucket; no exchange by the key alone is below it.
        text = out._jdf.queryExecution().executedPlan().toString()
        assert len(rows) > 8 and max(r["count"] for r in rows) < 700
        window = text[text.index("Window") :]
        assert "hashpartitioning(key" in window and "_bucket" in window[window.index("hashpartitioning(key") :][:80]
        got = {r["pos"]: r["depth"] for r in out.filter("key = 0").collect()}
        assert got == {p: i + 1 for i, p in enumerate(range(0, 4000, 2))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_keys_strings_and_ties(spark):
    rows = [(None, "a", 1, "x"), (None, "b", 1, "x"), (1, "a", 2, "y"), (1, "c", 2, "z"), (1, "c", 3, "z")]
    df = spark.createDataFrame(rows, "key int, pos string, tie int, value string")
    for b in (None, F.substring("pos", 1, 1)):
        got = sq.adjacent_duplicates(df, ["key"], ["pos", "tie"], "value", b).collect()
        assert sorted((str(r["key"]), r["pos"], r["tie"]) for r in got) == [("1", "c", 3), ("None", "b", 1)]


def test_nested_blocks_pair_by_level(spark):
    rows = [(1, 0, 1), (1, 1, 1), (1, 2, -1), (1, 3, -1), (1, 4, -1), (1, 5, 1), (2, 0, 1), (2, 1, 1), (2, 2, -1)]
    got = sq.level_pairs(spark.createDataFrame(rows, "key int, pos int, delta int"), ["key"], "pos", "delta").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3), (1, 1, 2), (2, 1, 2)]


def pairs_of(events):
    """Pairs of each key by walking its rows, one open row for each level."""
    out = []
    for key, rows in groups(events).items():
        level, last = 0, {}
        for _, pos, _, delta in rows:
            level += delta
            at = level + (delta < 0)
            before = last.get(at)
            if before and before[1] > 0 and delta < 0:
                out.append((key, before[0], pos))
            last[at] = (pos, delta)
    return sorted(out)


@pytest.mark.parametrize("width", WIDTHS)
def test_level_pairs_cross_buckets(frame, events, width):
    got = sq.level_pairs(frame, ["key"], "pos", "delta", bucket(width)).collect()
    assert sorted(map(tuple, got)) == pairs_of(events)


def test_a_pair_spans_many_buckets(spark):
    rows = [(None, 0, 1)] + [(None, i, 1 if i % 2 else -1) for i in range(1, 401)] + [(None, 999, -1)]
    df = spark.createDataFrame(rows, "key int, pos int, delta int")
    got = sq.level_pairs(df, ["key"], "pos", "delta", F.floor(F.col("pos") / 7)).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 999)] + [(i, i + 1) for i in range(1, 401, 2)]
    assert not sq.level_pairs(df.limit(0), ["key"], "pos", "delta", F.floor(F.col("pos") / 7)).collect()


@pytest.mark.parametrize("n", [1, 2, 16, 400])
def test_buckets_from_the_data(spark, events, n):
    """String orders with nulls and ties, and null keys: the rows are those without a bucket."""
    rows = [(None if k == 0 else k, None if p % 50 == 0 else f"p{p // 2:04d}", p, v, d) for k, p, v, d in events]
    df = spark.createDataFrame(rows, "key int, name string, pos int, value string, delta int")
    cut = sq.data_buckets(df, ["name", "pos"], n)
    order = ["name", "pos"]
    sizes = [r["count"] for r in df.groupBy(cut.alias("b")).count().collect()]
    assert n == 1 or (len(sizes) > n / 4 and max(sizes) < 4 * len(rows) / min(n, len(sizes)) + 30)
    for run in (
        lambda b: sq.adjacent_duplicates(df, ["key"], order, "value", b),
        lambda b: sq.after_terminator(df, ["key"], order, F.col("value") == "c", False, b),
        lambda b: sq.nesting_depth(df, ["key"], order, F.col("delta"), b),
    ):
        assert sorted(map(repr, run(cut).collect())) == sorted(map(repr, run(None).collect()))


def test_buckets_of_other_types(spark):
    df = spark.range(1000).select(
        F.timestamp_seconds("id").alias("ts"), F.to_date(F.timestamp_seconds(F.col("id") * 40000)).alias("day"),
        (F.col("id") / 3).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id").cast("decimal(12,2)")).alias("d"),
    )
    for column in df.columns:
        buckets = df.groupBy(sq.data_buckets(df, [column], 8).alias("b")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))
        rows = buckets.orderBy("b").collect()
        assert len(rows) >= 7 and all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]) if a["hi"] is not None)
    assert {r[0] for r in df.limit(0).select(sq.data_buckets(df.limit(0), ["ts"], 8)).collect()} == set()
    with pytest.raises(ValueError):
        sq.data_buckets(df, ["ts"], -1)


def test_group_missing_partner(frame, events):
    want = {k for k, g in groups(events).items() if any(r[2] == "a" for r in g) and not any(r[2] == "c" for r in g)}
    got = sq.group_missing_partner(frame, ["key"], F.col("value") == "a", F.col("value") == "c").collect()
    assert {r["key"] for r in got} == want


def test_bucketed_rule_summary(frame, events):
    got = {r["key"]: (r["a"], r["x"]) for r in sq.bucketed_rule_summary(frame, ["key"], "value", ["a", "x"]).collect()}
    assert got == {k: (sum(r[2] == "a" for r in g), 0) for k, g in groups(events).items()}


def test_page_tags_skip_scripts_and_void_tags(spark):
    html = '<div><script>var t="<p>";</script><br><!-- <b> --><p>x</P></div>'
    rows = sq.page_tags(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r["tag"], r["delta"]) for r in rows] == [("div", 1), ("br", 0), ("p", 1), ("p", -1), ("div", -1)]

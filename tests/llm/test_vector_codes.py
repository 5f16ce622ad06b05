"""Exact search and vector codes against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenscan.llm import ball_codes, integers, top_k

VECTORS = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind=VECTORS):
    return spark.createDataFrame(rows, kind).repartition(3).withColumns({"codes": F.lit(1), "rid": F.lit(2), "score": F.lit(3), "block": F.lit(4)})


def drawn(n=400, dim=32, seed=5):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.normal(size=dim)], int(draw.integers(4))) for i in range(n)]
    # Equal rows, vectors of a coarse grid with many ties, and rows that take no part.
    rows += [(n + i, rows[7][1], None) for i in range(30)]
    rows += [(n + 30 + i, [float(x) / 4 for x in draw.integers(-1, 2, dim)], 9) for i in range(60)]
    rows += [(n + 100, None, 1), (n + 101, [None] * dim, 1), (n + 102, [NAN] + [0.0] * (dim - 1), 1), (n + 103, [INF] * dim, 1), (n + 104, [1.0, None], 2)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def whole(values):
    return [int(np.floor(256 * np.float64(x))) for x in values]


def brute_top(rows, every, k):
    kept = [(i, whole(v)) for i, v, _ in usable(rows)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for n, (j, w) in enumerate(kept) if n != at and len(w) == len(v)]
            out += [(i, rank + 1, o[3], -o[0]) for rank, o in enumerate(sorted(others, key=lambda o: o[:3])[:k])]
    return sorted(out, key=str)


def top(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("least", "block", "fan", "step"), [(2048, 4096, 16, 128), (16, 8, 2, 3), (50, 1000, 3, 1)])
def test_top_k_equals_brute_force(spark, monkeypatch, least, block, fan, step):
    monkeypatch.setattr(top_k, "LEAST_ROWS", least)
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "FAN", fan)
    rows = drawn()
    got = top(top_k.top_k(table(spark, rows), F.col("vec_id") % 5 == 0, k=7))
    assert got == brute_top(rows, 5, 7)


def test_top_k_of_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (3, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (10, [], 1), (15, [], 1),
        (20, [1.0], 1), (25, [0.5, 0.25, -3.0], 2), (26, [1e6, 1e6, 1e6], 2), (30, [-1e6, 2e6, 0.001], 2),
    ]
    assert top(top_k.top_k(table(spark, rows), F.col("vec_id") % 5 == 0)) == brute_top(rows, 5, 5)
    assert top(top_k.top_k(table(spark, []), F.col("vec_id") % 5 == 0)) == []
    huge = [(0, [1e300, 1.0], 1), (1, [1e300, 1.0], 1), (5, [-1e300, 0.0], 1)]
    got = top(top_k.top_k(table(spark, huge), F.col("vec_id") % 5 == 0))
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 5, -(2**63)), (5, 1, 0, -(2**63)), (5, 2, 1, -(2**63))]


def test_top_k_takes_floats_exactly(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=8)], 0) for i in range(60)]
    df = table(spark, rows, "vec_id int, embedding array<float>, label int")
    assert top(top_k.top_k(df, F.col("vec_id") % 5 == 0)) == brute_top(rows, 5, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=20))
def test_packed_vectors(values):
    code = integers.packed(np.array(values, np.int64))
    assert integers.dimension(code) == len(values)
    assert integers.unpacked([code], len(values) + 2).tolist() == [[*values, 0, 0]]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 40, 2**20, 2**40]), st.integers(1, 12), st.integers(1, 30))
def test_ball_step_equals_all_distances(seed, spread, entries, n):
    draw = np.random.default_rng(seed)
    kind = object if spread > 2**24 else np.int64
    points, book = draw.integers(-spread, spread + 1, (n, 3)).astype(kind), draw.integers(-spread, spread + 1, (entries, 3)).astype(kind)
    own, far = ball_codes.nearest(points, book)
    mine, least, _ = ball_codes.ball_step(points, book, draw.integers(0, entries, n))
    assert mine.tolist() == own.tolist() and least.tolist() == far.tolist()


def test_cores_and_rings_save_work():
    draw = np.random.default_rng(3)
    book = draw.integers(-2000, 2000, (64, 4))
    points = book[draw.integers(0, 64, 5000)] + draw.integers(-20, 21, (5000, 4))
    own, _ = ball_codes.nearest(points, book)
    mine, _, work = ball_codes.ball_step(points, book + draw.integers(-3, 4, book.shape), own)
    assert (mine == own).mean() > 0.99 and work < 3 * len(points)


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) or 1
    vectors = [whole(v) + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for turn in range(rounds + 1):
        own = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if members := [c[p] for c, o in zip(cut, own) if o[p] == e]:
                        books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    errors = [min(sum(far(c[p], books[p][o[p]]) for p in range(parts)), integers.LONG) for c, o in zip(cut, own)]
    sums = {}
    for (_, _, label), error in zip(kept, errors):
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in o), e, min(sums[label], integers.LONG), digest) for (i, _, label), o, e in zip(kept, own, errors)), key=str)


def coded(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (8, 20, 3), (4, 3, 0), (5, 7, 1)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = drawn(200)
    got = coded(ball_codes.code_digests(*ball_codes.compress(table(spark, rows), parts, entries, rounds)))
    assert got == brute_codes(rows, parts, entries, rounds)


def test_codes_of_odd_rows(spark):
    rows = [
        (4, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.0], 1), (2, [], None), (None, [9.0], None), (1, [5.0] * 20, 2), (3, [1e9, -1e9], 2),
        (7, [2e9, -1e9], 2), (8, [0.0], 1),
    ]
    for entries in (64, 2):
        assert coded(ball_codes.code_digests(*ball_codes.compress(table(spark, rows), 4, entries, 2))) == brute_codes(rows, 4, entries, 2)
    assert coded(ball_codes.code_digests(*ball_codes.compress(table(spark, [])))) == []
    assert coded(ball_codes.code_digests(*ball_codes.compress(table(spark, [(1, None, 1)])))) == []
    with pytest.raises(ValueError, match="256"):
        ball_codes.compress(table(spark, rows), entries=300)

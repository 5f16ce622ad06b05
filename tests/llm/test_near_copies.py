"""SimHash groups, vectors and components against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenscan.llm import components, links, simhash, vectors

from .conftest import ODD


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [t or "" for _, t in ODD[:14]] + ["A b C d E f", "one", "one two"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_groups(rows):
    prints = [plain_fingerprint(t or "") for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union(len(rows), near)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, signed(p), least.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=str)


def near_copies():
    draw = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [str(w) for w in draw.choice(words, 200)]
        for _ in range(int(draw.integers(1, 25))):
            copy = list(base)
            for at in draw.integers(0, 200, int(draw.integers(0, 4))):
                copy[at] = str(draw.choice(words))
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


def test_groups_of_odd_documents(odd_docs):
    got = simhash.simhash_groups(odd_docs).select("doc_id", "fp", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(ODD)


@pytest.mark.parametrize("held", [2, 1 << 17])
def test_groups_of_near_copies(docs_of, held):
    rows = near_copies()
    got = simhash.simhash_groups(docs_of(rows), held=held).select("doc_id", "fp", "component_id").collect()
    want = brute_groups(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for *_, c in want}) < 0.8 * len(rows)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_span_all_pairs_within_a_distance(spark, distance):
    draw = np.random.default_rng(distance)
    prints = {0, 2**64 - 1}
    for center in draw.integers(0, 2**64, 6, np.uint64):
        for _ in range(30):
            prints.add(int(center) ^ sum(1 << int(b) for b in draw.integers(0, 64, int(draw.integers(0, 7)))) & (2**64 - 1))
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    place = {signed(p): i for i, p in enumerate(prints)}
    want = union(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= distance])
    for held in (3, 1000) if distance <= 2 else (1000,):
        found = simhash.links(df, distance, held).collect()
        assert union(len(prints), [(place[r.u], place[r.v]) for r in found]) == want


def test_masks_span_the_same_links_as_pairs(monkeypatch):
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 2**12, 600, np.uint64))
    pairs = simhash._group_links(prints, 2)
    monkeypatch.setattr(simhash, "PAIRWISE", 0)
    assert [x.tolist() for x in simhash._group_links(prints, 2)] == [x.tolist() for x in pairs]


def test_keep_one_of_each_group(odd_docs, docs_of, no_docs):
    kept = simhash.keep_one(odd_docs, 3, 2)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    groups = {}
    for i, fp, component in brute_groups(ODD):
        groups.setdefault((component, fp if component is None else 0), []).append(i)
    assert len(got) == len(groups)
    assert {r.doc_id for r in got if r.doc_id is not None} == {c for c, _ in groups if c is not None}
    assert simhash.keep_one(no_docs, 3, 2).collect() == []
    both = simhash.keep_one(docs_of([(1, "a b c d"), (1, "e f g h"), (1, "a b c d")]), 3, 2).collect()
    assert sorted(r.text for r in both) in (["a b c d", "e f g h"], ["a b c d"])


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_spanning_labels(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    assert links.spanning(n, a, b).tolist() == union(n, pairs)


def test_components_of_chains_stars_and_cycles(spark):
    draw = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    pairs += [tuple(map(int, p)) for p in draw.integers(400, 480, (60, 2))] + [(7, 7)]
    draw.shuffle(pairs)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "u bigint, v bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = union(500, [tuple(p) for p in pairs])
    assert got == {i: r for i, r in enumerate(want) if i != r}
    assert components.components(df.limit(0)).collect() == []


VECTORS = "vec_id bigint, embedding array<float>, label int, n int, rid int, block string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], VECTORS).repartition(3)


def brute_vectors(rows, threshold=0.98):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    near = [
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if rows[i][2] == rows[j][2] and usable(*rows[i][1:]) and usable(*rows[j][1:])
        and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold
    ]
    roots, counts = union(len(rows), near), np.bincount(np.array(near, int).ravel(), minlength=len(rows))
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, int(n), least.get(r), i == least.get(r)) for (i, *_), n, r in zip(rows, counts, roots)), key=str)


def clusters(n, copies):
    draw = np.random.default_rng(2)
    rows = []
    for c in range(n):
        center = draw.standard_normal(16)
        for _ in range(int(draw.integers(1, copies))):
            rows.append((len(rows), (center + draw.standard_normal(16) * draw.choice([0.0, 0.05, 0.12])).tolist(), c % 3))
    order = draw.permutation(len(rows))
    return [(int(o), r[1], r[2]) for o, r in zip(order, rows)]


def test_vectors_against_all_pairs(spark):
    odd = [
        (1000, [0.0] * 16, 1), (1001, None, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, [], 1),
        (1005, [None] + [1.0] * 15, 1), (1006, [1.0] * 16, None), (1007, [1.0] * 16, 1), (1008, [2.0] * 16, 1), (1007, [1.0] * 16, 1),
        (None, [3.0] * 16, 1), (1009, [1.0] * 15, 1), (None, [1.0, -1.0] * 8, 2), (1010, [1e30] * 16, 1), (-5, [1e-30] * 16, 1),
    ]
    rows = clusters(20, 20) + odd
    assert sorted(map(tuple, vectors.near_vectors(vectors_of(spark, rows)).collect()), key=str) == brute_vectors(rows)


def test_vectors_with_small_windows_find_nearly_all(spark):
    rows = clusters(30, 12)
    got = vectors.near_vectors(vectors_of(spark, rows), window=16).collect()
    want = {w[0]: w for w in brute_vectors(rows)}
    assert sum(r.n_links for r in got) >= 0.9 * sum(w[1] for w in want.values())
    assert all(r.n_links <= want[r.vec_id][1] for r in got)
    assert np.mean([r.component_id == want[r.vec_id][2] for r in got]) >= 0.9


def test_many_equal_vectors_are_one_node(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(300)] + [(i, [1.0, 2.0, 3.01], 1) for i in range(300, 303)]
    got = vectors.near_vectors(vectors_of(spark, rows), window=8).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(302, 0)} and sum(r.kept for r in got) == 1
    assert vectors.near_vectors(vectors_of(spark, rows).limit(0)).collect() == []


def test_links_of_a_cluster_larger_than_the_window_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 100)
    draw = np.random.default_rng(10)
    center = draw.standard_normal(16)
    rows = [(i, (center + 0.1 * draw.standard_normal(16)).tolist(), 1) for i in range(500)]
    rows += [(500 + i, [float(x) for x in rows[0][1]], 1) for i in range(3)]
    rows += [(600 + i, (float(i + 2) * np.array(rows[1][1])).tolist(), 1) for i in range(80)]
    got = vectors.near_vectors(vectors_of(spark, rows), window=16, passes=6).collect()
    assert sorted(map(tuple, got), key=str) == brute_vectors(rows)


def test_pairs_in_a_large_narrow_label_are_found(spark):
    """100,000 vectors of one label at a mean cosine of 0.9, with pairs planted just above the threshold."""
    rng = np.random.default_rng(11)
    n, pairs, dim = 100_000, 500, 64

    def direction(k):
        x = rng.standard_normal((k, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    middle = direction(1)
    rows = np.sqrt(0.9) * middle + np.sqrt(0.1) * direction(n)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    aside = direction(pairs)
    aside -= (aside * rows[:pairs]).sum(axis=1, keepdims=True) * rows[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows[pairs : 2 * pairs] = 0.981 * rows[:pairs] + np.sqrt(1 - 0.981**2) * aside
    table = pa.table({"vec_id": np.arange(n), "label": np.zeros(n, np.int64), "embedding": list(rows)})
    got = vectors.near_vectors(spark.createDataFrame(table)).filter(F.col("vec_id") < pairs)
    found = got.filter("n_links > 0").count()
    assert found >= 0.95 * pairs


def test_passes_grow_with_size_and_narrowness_only_beyond_the_least(spark):
    rng = np.random.default_rng(5)
    wide, narrow = rng.standard_normal((300, 8)), rng.standard_normal((300, 8)) + 9
    rows = [(0, v.tolist()) for v in wide] + [(1, v.tolist()) for v in narrow] + [(2, [1.0, 2.0])] + [(2, [0.5, 1.0, 3.0])]
    table = spark.createDataFrame(rows, "label bigint, embedding array<double>")
    shapes = {(r["label"], r["dim"]): r for r in vectors._shapes(table, 0.98, 2, 50, 8, 0.01).collect()}
    assert set(shapes) == {(0, 8), (1, 8), (2, 2), (2, 3)}
    assert 2 < shapes[0, 8]["passes"] < shapes[1, 8]["passes"] <= 50 and shapes[2, 2]["passes"] == 7
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    assert np.allclose(shapes[0, 8]["mean"], unit.mean(axis=0))

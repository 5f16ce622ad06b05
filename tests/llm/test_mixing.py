"""Mixing: exponents, weights, budgets and the order of the mix."""

import math
from collections import Counter

import numpy as np
import pytest

from lumenscan.llm import mixing

from .conftest import ODD

SIZES = {"big": 400, "mid": 100, "low": 20, None: 50}


def sources(docs_of):
    rows, i = [], 0
    for source, n in SIZES.items():
        for k in range(n):
            rows.append((i, "w " * (10 + k % 7), source))
            i += 1
    return rows, docs_of(rows, parts=4, extra=("weight", "mix_epoch", "tokens", "cut"))


def tokens_by_source(rows):
    out = Counter()
    for _, text, source in rows:
        out[source] += len(text.split())
    return out


def reads(df):
    out = Counter()
    for r in df.collect():
        out[r.source] += r.mix_tokens
    return out


def entropy(tokens):
    p = np.array(list(tokens.values())) / sum(tokens.values())
    return -(p * np.log(p)).sum() / math.log(len(p))


@pytest.mark.parametrize("repeats", [1.0, 1.5, 2.0, 4.0])
def test_repetition_limit(docs_of, repeats):
    rows, docs = sources(docs_of)
    total, mixed = tokens_by_source(rows), mixing.mix(docs, max_repeats=repeats)
    got = reads(mixed)
    ratio = {s: got[s] / total[s] for s in total}
    assert ratio["big"] == 1 and ratio["low"] == pytest.approx(repeats, rel=0.06) and max(ratio.values()) <= repeats + 1e-9
    a = 1 - math.log(repeats) / math.log(total["big"] / total["low"])
    assert ratio["mid"] == pytest.approx((total["mid"] / total["big"]) ** (a - 1), rel=0.03)
    whole = {r.doc_id for r in mixed.collect()}
    assert whole == {i for i, *_ in rows}


@pytest.mark.parametrize("target", [0.75, 0.9, 1.0])
def test_entropy_target(docs_of, target):
    rows, docs = sources(docs_of)
    got = reads(mixing.mix(docs, entropy=target, max_repeats=None))
    assert entropy(got) == pytest.approx(target, abs=0.005)
    natural = entropy(tokens_by_source(rows))
    assert entropy(reads(mixing.mix(docs, entropy=natural / 2, max_repeats=None))) == pytest.approx(natural, abs=1e-6)


@pytest.mark.parametrize("budget", [300, 3000, 20_000])
def test_budget_is_met_and_not_passed(docs_of, budget):
    rows, docs = sources(docs_of)
    rows_out = mixing.mix(docs, entropy=0.95, max_repeats=None, budget=budget).collect()
    used = sum(r.mix_tokens for r in rows_out)
    assert budget - 4 * 17 <= used <= budget
    copies = Counter((r.doc_id, r.mix_epoch) for r in rows_out)
    assert max(copies.values()) == 1
    by_source = {s: Counter(r.doc_id for r in rows_out if r.source == s) for s in SIZES}
    for s, counts in by_source.items():  # epochs are whole but for the last
        assert not counts or max(counts.values()) - (min(counts.values()) if len(counts) == SIZES[s] else 0) <= 1


def test_every_stretch_has_the_weights(docs_of):
    _, docs = sources(docs_of)
    rows = sorted(mixing.mix(docs, max_repeats=3.0).collect(), key=lambda r: r.mix_order)
    whole = Counter(r.source for r in rows)
    for part in np.array_split(np.arange(len(rows)), 4):
        here = Counter(rows[i].source for i in part)
        assert all(here[s] / len(part) == pytest.approx(whole[s] / len(rows), abs=0.08) for s in whole)


def test_block_cut_equals_a_plain_prefix(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows, docs = sources(docs_of)
    few = {(r.doc_id, r.mix_epoch) for r in mixing.mix(docs, max_repeats=1.7).collect()}
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1 << 30)
    assert few == {(r.doc_id, r.mix_epoch) for r in mixing.mix(docs, max_repeats=1.7).collect()}


def test_odd_documents(odd_docs, no_docs, docs_of):
    mixed = mixing.in_mix_order(odd_docs, 3)
    assert mixed.columns == odd_docs.columns and mixed.count() == len(ODD)
    assert mixing.mix(no_docs).collect() == [] and mixing.in_mix_order(no_docs, 2).collect() == []
    empty = mixing.mix(docs_of([(1, "", "a"), (2, None, "b"), (3, "x y", "c")])).collect()
    assert sorted(r.doc_id for r in empty) == [1, 2, 3]


def test_word_count(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in ("", None, " ", "a", " a\tb\n c ", "x\x0by", "é ü")], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 2, 2]

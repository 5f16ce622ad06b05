"""Order MinHash and stupid backoff against brute force."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest

from lumenscan.llm import backoff
from lumenscan.llm import order_minhash as om

from .conftest import ODD


def test_likeness_follows_edits_and_order():
    hasher = om.OrderMinHash()
    words = [f"w{i}" for i in range(300)]
    sign = lambda ws: hasher.signature(" ".join(ws))
    whole = sign(words)
    few, many = list(words), list(words)
    few[50:52] = ["x", "y"]
    many[50:150] = [f"z{i}" for i in range(100)]
    moved = words[150:] + words[:150]
    near = [om.likeness(whole, sign(x)) for x in (words, few, many, [f"q{i}" for i in range(300)])]
    assert near[0] == 1 and near[1] > 0.85 and near[1] > near[2] > 0.1 and near[3] < 0.05
    assert om.likeness(whole, sign(moved)) < 0.75  # the same k-mers but for three, in another order


def test_a_tuple_is_that_of_the_smallest_kmers_in_text_order():
    hasher = om.OrderMinHash(k=2, ell=3, functions=5)
    text = "a b a b c a b a d e"
    kmers = hasher._kmers(text).tolist()
    seen, items = Counter(), []
    for k in kmers:
        items.append(int(om.mix(np.array([k], np.uint64) + np.array([seen[k]], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]))
        seen[k] += 1
    for j, got in enumerate(hasher.signature(text)):
        order = sorted(range(len(items)), key=lambda i: ((items[i] ^ int(hasher.flip[j])) * int(hasher.times[j])) % 2**64)[:3]
        value = np.array([3], np.uint64)
        for i in sorted(order):
            value = om.mix(value + np.uint64(kmers[i]))
        assert int(value[0]) >> 48 == got


def test_edited_texts_of_odd_documents(odd_docs):
    got = sorted(map(tuple, om.edit_fingerprints(odd_docs).collect()), key=str)
    rows = [(i, t or "") for i, t in ODD]
    hasher, wants = om.OrderMinHash(), []
    # Equal ids may stand in either order of their texts; here they have equal texts or are null.
    for nulls in itertools.permutations([r for r in rows if r[0] is None]):
        ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + list(nulls)
        want = []
        for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
            edited = om.edited_text(text, after)
            a, b, c = (hasher.signature(x) for x in (text, edited, after))
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), om.to_text(a), om.to_text(b), om.likeness(a, b), om.likeness(a, c)))
        wants.append(sorted(want, key=str))
    assert got in wants


def test_edited_text():
    assert om.edited_text("abcdef", "XYZ") == "abcdXY"
    assert om.edited_text("abcdef", "X") == "abcdX"
    assert om.edited_text("ab", "X") == "ab"


@pytest.mark.parametrize("rows", [[], [(4, "a b c d e f g h i")], [(i, f"text number {i} of some") for i in range(40)]])
def test_edit_fingerprints_of_small_tables(docs_of, rows):
    got = {r.doc_id: r for r in om.edit_fingerprints(docs_of(rows, parts=7)).collect()}
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(rows):
        edited = om.edited_text(text, rows[at - 1][1])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_plain_fingerprints_equal_those_of_edits(odd_docs):
    plain = sorted(map(tuple, om.fingerprints(odd_docs).collect()), key=str)
    assert plain == sorted(((r.doc_id, r.fingerprint) for r in om.edit_fingerprints(odd_docs).collect()), key=str)


def brute_scores(rows, order, min_count):
    texts = [backoff.words_of(t) for _, t in rows]
    ngrams = lambda ws: Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    counts = sum(map(ngrams, texts), Counter())
    total = sum(map(len, texts))

    def score(ws):
        own = ngrams(ws)
        n = lambda gram: counts[gram] - own[gram]

        def word(history, w):
            if not history:
                here = math.log(max(n((w,)), 1) / max(total - len(ws), 1))
                return here if n((w,)) else here + math.log(0.4)
            if n((*history, w)) >= min_count:
                return math.log(n((*history, w)) / n(history))
            return math.log(0.4) + word(history[1:], w)

        return sum(word(tuple(ws[max(0, j - order + 1) : j]), w) for j, w in enumerate(ws))

    return [(i, len(ws), score(ws)) for (i, _), ws in zip(rows, texts)]


@pytest.mark.parametrize("order,min_count,chunk", [(2, 2, 1 << 20), (3, 2, 300), (1, 1, 100), (4, 1, 1000)])
def test_scores(docs_of, order, min_count, chunk):
    rows = ODD[:-4] + [(20 + i, "the cat sat on the mat and the dog sat on the cat" + " again" * i) for i in range(30)]
    df = docs_of(rows, extra=("n_tokens", "chunk", "n", "bucket"))
    got = backoff.backoff_scores(df, order, min_count, chunk_bytes=chunk, bucket_bytes=chunk).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    for g, w in zip(sorted(got, key=key), sorted(brute_scores(rows, order, min_count), key=key), strict=True):
        assert g[:2] == w[:2] and g.log_score == pytest.approx(w[2], rel=1e-9, abs=1e-9)
        assert (g.mean_log_score is None) == (g.n_tokens == 0)


def test_count_table(docs_of, no_docs):
    got = backoff.ngram_counts(docs_of([(1, "a b a b"), (2, "B a"), (3, None)]), order=2).collect()
    assert sorted((r.n, r["count"]) for r in got) == [(1, 3), (1, 3), (2, 2), (2, 2)]
    assert backoff.backoff_scores(no_docs).collect() == [] and backoff.ngram_counts(no_docs).collect() == []


def test_words_found_nowhere_else_score_below_fluent_text(docs_of):
    fluent = "the cat sat on the mat and the dog sat on the rug"
    rows = [(i, " ".join(fluent.split()[i % 4 :]) + f" today {i}") for i in range(20)]
    rows += [(100, "zq1 zq2 zq3 zq4 zq5 zq6 zq7 zq8 zq9 zq10"), (101, "the rug sat on the dog"), (102, "alone")]
    got = {r.doc_id: r for r in backoff.backoff_scores(docs_of(rows)).collect()}
    for g, w in zip(sorted(got.values()), sorted(brute_scores(rows, 3, 1)), strict=True):
        assert g[:2] == w[:2] and g.log_score == pytest.approx(w[2])
    means = {i: r.mean_log_score for i, r in got.items()}
    assert means[100] < means[101] < means[0] and all(means[100] <= m for m in means.values())
    (single,) = backoff.backoff_scores(docs_of([(1, "a b")])).collect()
    assert single.log_score == pytest.approx(math.log(0.4) * 3)

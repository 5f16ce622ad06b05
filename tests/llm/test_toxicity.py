"""The recurrent network: gradients, windows, and accuracy on held-out documents."""

import zlib

import numpy as np
import pytest

from lumenscan.llm import recurrent as rn
from lumenscan.llm import toxicity

from .conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 96, 97, 1000])
def test_windows_overlap_and_cover_everything(n):
    starts = rn.windows_of(n, 64, 32)
    covered = {i for s in starts for i in range(s, min(s + 64, n))}
    assert covered == set(range(n)) and len(starts) == (0 if not n else max(1, -(-(n - 64) // 32) + 1))
    assert all(b - a == 32 for a, b in zip(starts, starts[1:]))


def test_long_words_are_cut_not_lost():
    assert rn.tokens_of("Ab " + "x" * 50) == ["ab", "x" * 24, "x" * 24, "xx"]
    assert rn.tokens_of(" \n") == []


def test_gradients_are_those_of_the_loss():
    net = rn.Network(hidden=3, width=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    tokens = ["bad", "word", "fine", "x"]
    where, lengths, _ = rn.arrange([(0, 5), (2, 3), (5, 1)], 8)
    places = np.array([0, 1, 2, 0, 3, 1])[where]
    target = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.logaddexp(0, (1 - 2 * target) * net.logits(net.project(net.embed(tokens)[0].astype(float)), places, lengths)).sum())
    grads, _ = net.gradients(tokens, places, lengths, lambda out: rn.sigmoid(out) - target)
    for name, grad in grads.items():
        flat = np.abs(grad).ravel()
        for at in np.argsort(flat)[-3:]:
            index = np.unravel_index(at, grad.shape)
            kept = net.p[name][index]
            net.p[name][index] = kept + 1e-3
            up = loss()
            net.p[name][index] = kept - 1e-3
            down = loss()
            net.p[name][index] = kept
            assert grad[index] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-3), name


def plain_logit(net, tokens):
    """One window, token by token and gate by gate, in double precision."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, net.hidden
    given = []
    for token in tokens:
        raw = token.encode()
        bare = raw.strip(b".,;:!?\"'()[]") or raw
        edged, grams = b"\2" + bare + b"\3", []
        for a, b, c in zip(edged, edged[1:], edged[2:]):
            gram = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
            grams.append(p["grams"][(gram ^ (gram >> 15)) % rn.GRAMS])
        both = np.concatenate([p["words"][zlib.crc32(bare) % rn.WORDS], sum(grams) / len(grams)])
        given.append(both @ p["in"] + p["in_bias"])

    def states(order, first, weights):
        state, out = np.zeros(h), {}
        for t in order:
            reset_in, update_in, fresh_in = given[t][first : first + 3 * h].reshape(3, h)
            reset_last, update_last, fresh_last = (state @ weights).reshape(3, h)
            reset, update = 1 / (1 + np.exp(-reset_in - reset_last)), 1 / (1 + np.exp(-update_in - update_last))
            state = update * state + (1 - update) * np.tanh(fresh_in + reset * fresh_last)
            out[t] = state
        return out

    n = len(tokens)
    ahead, back = states(range(n), 0, p["forward"]), states(range(n - 1, -1, -1), 3 * h, p["backward"])
    both = [np.concatenate([ahead[t], back[t]]) for t in range(n)]
    shares = [np.exp(x @ p["attend"]) for x in both]
    return float(sum(s * x for s, x in zip(shares, both)) / sum(shares) @ p["out"] + p["out_bias"][0])


def plain_score(net, text):
    """The probability of the worst window, all windows listed."""
    tokens, spans, begin = rn.tokens_of(text), [], 0
    while True:
        spans.append(tokens[begin : begin + toxicity.WINDOW])
        if begin + toxicity.WINDOW >= len(tokens):
            break
        begin += toxicity.STRIDE
    return max(1 / (1 + np.exp(-plain_logit(net, span))) for span in spans)


def test_scores_are_those_of_a_plain_network(learned):
    rows, _, _, model = learned
    long = " ".join(t for _, t in rows[:12]) + " (Vilea), \u00e9t\u00e9! " + "x" * 60
    texts = [t for _, t in rows[12:24]] + [long, "one", "!?"]
    got = model.scores(model.scorer(), texts)
    assert np.allclose(got, [plain_score(model.network, t) for t in texts], atol=2e-3)


def corpus(n, seed):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [str(w) for w in draw.choice(words, int(draw.integers(5, 150)))]
        if toxic:
            for _ in range(3):
                text.insert(int(draw.integers(0, len(text))), f"vile{draw.choice(list('abcdef'))}")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, docs_of):
    rows, labels = corpus(1200, 1)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return rows, labels, docs_of(rows), toxicity.fit(docs_of(rows), table, steps=120)


def test_held_out_documents(learned):
    _, labels, docs, model = learned
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 150 and np.mean([p == y for p, y in held]) > 0.95


def test_scores_do_not_depend_on_batches(learned):
    rows, _, _, model = learned
    one = model.scores(model.scorer(), [t for _, t in rows[:100]])
    scorer = model.scorer()
    each = np.concatenate([model.scores(scorer, [t]) for _, t in rows[:100]])
    assert np.allclose(one, each, atol=1e-4)
    long = " ".join(["w1"] * 5000 + ["vilea", "vileb", "vilec"] + ["w2"] * 5000)
    assert model.scores(scorer, [long])[0] > 0.5


def test_only_the_allowed_fold_is_learned_from(spark, docs_of):
    rows, labels = corpus(200, 2)
    table = lambda ls: spark.createDataFrame(ls, "doc_id bigint, quality int, toxic int")
    flipped = [(i, q, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, y) for i, q, y in labels]
    a, b = (toxicity.fit(docs_of(rows), table(x), steps=2) for x in (labels, flipped))
    assert a.base == b.base and all(np.array_equal(a.network.p[k], b.network.p[k]) for k in a.network.p)


def test_odd_documents_and_no_labels(spark, odd_docs, no_docs, learned):
    model = learned[3]
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {model.base} and model.base < 0.5
    kept = toxicity.keep_clean(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(no_docs, model).collect() == [] and toxicity.keep_clean(no_docs, model).collect() == []
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    empty = toxicity.fit(odd_docs, labels)
    assert empty.network is None and {r.score for r in toxicity.score(odd_docs, empty).collect()} == {0.0}

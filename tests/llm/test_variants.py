"""Automata, word counts and spelling variants against brute force."""

import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenscan.llm import variants
from lumenscan.llm.automata import Acceptor, one_edit_pairs


def one_apart(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


LISTS = st.lists(st.sets(st.text("abc", max_size=5), max_size=25).map(sorted), max_size=3)


@settings(max_examples=200, deadline=None)
@given(LISTS)
def test_composition_gives_each_pair_once(lists):
    acceptor = Acceptor()
    starts = [acceptor.start(words) for words in lists]
    near = one_edit_pairs(acceptor)
    for words, start in zip(lists, starts):
        got = sorted(tuple(sorted((words[i], words[j]))) for i, j in near[start])
        assert got == sorted((u, v) for u in words for v in words if u < v and one_apart(u, v))


@settings(max_examples=100, deadline=None)
@given(LISTS)
def test_acceptor_is_minimal_and_numbers_its_words(lists):
    acceptor = Acceptor()
    starts = [acceptor.start(words) for words in lists]

    def language(state, prefix="", place=0):
        out = [(prefix, place)] if acceptor.final[state] else []
        for label, (target, rank) in acceptor.arcs[state].items():
            out += language(target, prefix + label, place + rank)
        return out

    for words, start in zip(lists, starts):
        assert sorted(language(start)) == [(w, i) for i, w in enumerate(words)]
    right = [tuple(sorted(language(state))) for state in range(len(acceptor.arcs))]
    assert len(right) == len(set(right))


def test_very_long_words_need_no_recursion():
    acceptor = Acceptor()
    words = sorted(["a" * 30_000, "a" * 30_001, "a" * 29_999 + "b"])
    start = acceptor.start(words)
    assert sorted(one_edit_pairs(acceptor)[start]) == [(0, 1), (0, 2)]


def plain_words(doc_id, text, one_in):
    out, run = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif run:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out.append(run)
            run = ""
    return out


def brute(rows, least_length=6, least_count=5, ratio=5, one_in=None):
    total = Counter(w for doc_id, text, *_ in rows for w in plain_words(doc_id, text, one_in) if len(w) >= least_length)
    n = {w: c for w, c in total.items() if c >= least_count}
    out = {}
    for w in n:
        near = sorted((v for v in n if v != w and one_apart(v, w)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= ratio * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def texts():
    """Words with variants at every place, chains of forms, ties, accents and doubled letters."""
    lines = {
        "correct": 130, "corect": 26, "corrects": 20, "korrect": 5, "coreck": 5, "correctly": 9, "corredtly": 5,
        "bananana": 25, "banananana": 5, "bananaa": 5, "ababab": 40, "bababa": 40, "abababa": 8, "babababa": 6,
        "élèveÿñ": 30, "elèveÿñ": 6, "ÉLÈVEÿñ": 5, "aaaaaa": 60, "aaaaaaa": 12, "aaaaaaaa": 5, "tiesxa": 50,
        "tiesxb": 50, "tiesxc": 10, "once": 99, "seldomly": 4, "x" * 9000: 50, "x" * 8999: 5,
    }
    words = [w for w, n in lines.items() for _ in range(n)]
    return [(i, " ".join(words[i::7]) + "·ßĀMixed1Mixed_mixed") for i in range(7)]


@pytest.mark.parametrize(("held", "one_in"), [(variants.HELD, None), (2, None), (variants.HELD, 3), (3, 2)])
def test_variants_equal_brute_force(docs_of, held, one_in):
    rows = texts()
    got = found(variants.spelling_variants(docs_of(rows, extra=("n", "word", "prefix", "kind")), one_in=one_in, held=held))
    assert got == brute(rows, one_in=one_in)


def test_chains_and_ties(docs_of):
    got = found(variants.spelling_variants(docs_of(texts())))
    assert got["coreck"][:2] == ("corect", "correct") and got["corect"][0] == "correct"
    assert got["tiesxc"][0] == "tiesxa" and got["tiesxa"][0] is None
    assert got["x" * 8999][0] == "x" * 9000


def test_many_words_of_one_stem_are_divided(spark, docs_of):
    """A third of the words share a stem and more than a task may hold: divided, with the same result."""
    stem = [f"stem{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    rest = ["other" + w[::-1] for w in stem[::2]]
    rows = [(i, " ".join((stem + rest)[i % 2 :: 1 + i % 3] * 5)) for i in range(6)]
    assert found(variants.spelling_variants(docs_of(rows), held=20)) == brute(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.text("abAB À×Ā", max_size=60)), max_size=12))
def test_random_texts(docs_of, rows):
    options = {"least_length": 1, "least_count": 1, "ratio": 2, "one_in": 3}
    if rows:
        kept = [(i, t) for i, t in rows]
        assert found(variants.spelling_variants(docs_of(kept), **options)) == brute(kept, **options)


def test_odd_rows(odd_docs, no_docs):
    from .conftest import ODD

    assert found(variants.spelling_variants(odd_docs, least_count=1, one_in=5)) == brute(ODD, least_count=1, one_in=5)
    assert found(variants.spelling_variants(no_docs)) == {}
    with pytest.raises(ValueError, match="frequent"):
        variants.spelling_variants(no_docs, ratio=1)

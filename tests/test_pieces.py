"""Texts lexed in pieces give the rows of the lexer of whole texts."""

import random

import pytest

from lumenscan.operators import lexing, pieces

PARTS = [
    "x", "\n", "\n", "\nlocal a = 1\n", "[[", "]]", "[=[", "]=]", "--[[", "--[==[", "]==]", "--", '"', "'", "`", "\\", "\\z", " ", "{", "}",
    "1.5", "..", "é", "a[b[1]]\n", "\r\n", "->", "]", "[", "=", "😀", "if x then\n", "end\n",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(units, chars):
    assert rows(pieces.tokens(units, chars)) == rows(lexing.tokens(units))
    assert rows(pieces.token_classes(units, chars)) == rows(lexing.token_classes(units))


def test_random_texts(units_of):
    deal = random.Random(7)
    texts = {f"u{i}": "".join(deal.choices(PARTS, k=deal.randrange(1, 120))) for i in range(600)}
    units = units_of(texts)
    assert pieces.pieces(units, 8).count() > 2 * len(texts)
    for chars in (1, 8, 40):
        same(units, chars)


LONG = "local s = [==[ a\nb ]]\n[[ c\n]=]\nd ]==] .. t\n--[[ one\ntwo\n--[=[ three\n]] local u = a[b[1]]\nlocal v = [=[ never\nw()\n"


def test_brackets_over_many_pieces(units_of):
    units = units_of({"u": LONG, "open": "--[[ a\nb\nc\n", "empty": "", "line": "x = 1", "null": None})
    same(units, 1)
    found = {(r["unit_id"], r["cls"]): r["text"] for r in pieces.tokens(units, 1).collect()}
    assert found["u", "raw_string"] == LONG[LONG.index("[==[") : LONG.index("]==]") + 4]
    assert ("open", "name") in found and "empty" not in {u for u, _ in found}


def test_one_large_text_is_many_tasks(units_of):
    units = units_of({"u": LONG.replace("[=[ never", "[=[ once\n]=]") * 3000})
    cut = pieces.pieces(units, 5000)
    sizes = [len(r["content"]) for r in cut.collect()]
    assert len(sizes) > 50 and max(sizes) < 5100
    same(units, 5000)


def test_modes_are_composed_in_order(units_of):
    cut = pieces.pieces(units_of({"u": "a = [[\nb\nc\n]] .. [=[\nd\n]=]\ne\n"}), 1)
    modes = {r["piece"]: (r["head"], r["owner"]) for r in pieces.entry_modes(pieces.transitions(cut)).collect()}
    assert [modes[i][0] for i in sorted(modes)] == ["", "[[", "[[", "[[", "[=[", "[=[", ""]
    assert [modes[i][1] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 3, 3]


def test_other_columns_and_odd_sizes(units_of):
    units = units_of({"u": LONG}).selectExpr("*", "1 AS piece", "2 AS start", "'x' AS head")
    same(units, 3)
    assert pieces.tokens(units.limit(0), 3).isEmpty()
    with pytest.raises(ValueError, match="one character"):
        pieces.tokens(units, 0)

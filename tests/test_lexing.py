"""Tokens, depths and pairs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenscan.functions import lexicon as lx
from lumenscan.operators import blocks, diagnostics, lexing

SOURCE = """-- head
local a = 0x1F + .5 -- tail
--[[ block
comment ]]
local s, t = "x\\"y", 'z' .. [==[ raw ]] ]==]
if a ~= nil then f(`in {a}`) elseif b then g() end
a ..= 1e-3
"""


@pytest.fixture(scope="module")
def tokens(units_of):
    return lexing.tokens(units_of({"u": SOURCE}))


def test_texts_lines_and_offsets(tokens):
    rows = tokens.orderBy("tok_no").collect()
    assert [r["tok_no"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert SOURCE[r["start"] : r["start"] + len(r["text"])] == r["text"]
        assert r["line"] == SOURCE[: r["start"]].count("\n") + 1
        assert r["col"] == r["start"] - (SOURCE.rfind("\n", 0, r["start"]) + 1)


def test_classes(tokens):
    got = {r["text"]: r["cls"] for r in tokens.collect()}
    want = {
        "local": "keyword", "a": "name", "0x1F": "number", ".5": "number", '"x\\"y"': "string", "'z'": "string",
        "..": "operator", "[==[ raw ]] ]==]": "raw_string", "~=": "operator", "`in {a}`": "interpolated", "(": "other",
        "..=": "operator", "1e-3": "number",
    }
    assert {k: got[k] for k in want} == want


def test_class_counts_include_trivia(units_of):
    counts = {r["cls"]: r["n_tokens"] for r in lexing.token_classes(units_of({"u": SOURCE})).collect()}
    assert counts["comment"] == 3
    assert counts["raw_string"] == 1
    assert counts["whitespace"] > 10


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([
    "if", "then", "end", "function", "f(", ")", "[[", "]]", "[=[", "]=]", "--", "--[[", '"', "'", "`", "\\", "\n", " ", "x",
    "1.", "..", "=", "é", ";", "local", "return", "until", "repeat", "do", "while",
]), max_size=60))
def test_every_lexer_is_lossless(spark, parts):
    text = "".join(parts)
    frame = spark.createDataFrame([("u", text)], "unit_id string, content string")
    for pattern in (lx.TOKEN_LEX, lx.SCAN_LEX, lx.RAW_LEX):
        joined = F.array_join(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), "")
        assert frame.select(joined).first()[0] == text


def test_long_and_unterminated_texts_do_not_recurse(spark):
    texts = ["[[" * 20000, '"' + "\\n" * 50000, "(" * 50000, "-- c\n" * 50000, "x = " + "a + " * 50000, "f(" * 2000 + ")" * 2000]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, content string")
    for pattern in (lx.TOKEN_LEX, lx.SCAN_LEX):
        length = F.length(F.array_join(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), ""))
        assert frame.filter(length != F.length("content")).count() == 0


def test_depths(tokens):
    rows = blocks.block_depth(tokens).orderBy("tok_no").collect()
    assert (rows[-1]["depth"], rows[-1]["bracket_depth"]) == (0, 0)
    assert max(r["depth"] for r in rows) == 1
    assert min(r["depth"] for r in rows) == 0


def test_value_ifs_open_no_block(units_of):
    source = "local x = if a then 1 else 2\nlocal y = (if a then 1 elseif b then 2 else 3)\nif c then d() else if e then f() end end\n"
    rows = blocks.block_depth(lexing.tokens(units_of({"u": source}))).orderBy("tok_no").collect()
    assert rows[-1]["depth"] == 0
    assert [r["depth"] for r in rows if r["text"] == "then"] == [0, 0, 0, 1, 2]


def test_pairs(units_of):
    source = "while a do repeat f(x[1]) until b end"
    rows = blocks.block_pairs(lexing.tokens(units_of({"u": source}))).collect()
    got = sorted((r["opener"], r["closer"], r["level"]) for r in rows)
    assert got == [("(", ")", 0), ("[", "]", 1), ("do", "end", 0), ("repeat", "until", 1)]
    assert all(r["open_tok"] < r["close_tok"] for r in rows)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("f(x)\n", []),
        ("do\nf(x)\n", [("unclosed block 'do'", 1, 0)]),
        ("f()\nend\n", [("unexpected 'end'", 2, 0)]),
        ("f(\n", [("unclosed bracket '('", 1, 1)]),
        ("f)\n", [("unexpected bracket ')'", 1, 1)]),
        ('x = "abc\n', [("unterminated string '\"abc'", 1, 4)]),
    ],
)
def test_diagnostics(units_of, source, want):
    rows = diagnostics.diagnostics(lexing.tokens(units_of({"u": source}))).collect()
    assert sorted((r["message"], r["line"], r["col"]) for r in rows) == want

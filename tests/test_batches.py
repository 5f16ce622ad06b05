"""Files derived in batches of arrays: no window over rows, and the rows that windows gave."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenscan.batches import findings as bf
from lumenscan.batches import lexemes as bx
from lumenscan.batches import patterns as px
from lumenscan.batches.windows import Window, sorted_by
from lumenscan.functions import lexicon as lx
from lumenscan.operators import blocks, diagnostics, elements, lexing, pieces, rules
from lumenscan.operators import outline as o
from lumenscan.plans import outcomes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_arrays():
    key, x = np.array([1, 2, 1, 2, 1]), np.array([5, 1, 7, 2, 9])
    w = Window(sorted_by(key), key)
    assert w.total(x).tolist() == [5, 1, 12, 3, 21]
    assert w.lag(x, -1).tolist() == [-1, -1, 5, 1, 7]
    assert w.lead(x, -1).tolist() == [7, 2, 9, -1, -1]
    assert w.newest(x > 5).tolist() == [-1, -1, 2, -1, 4]
    assert w.newest(x > 1, before=True).tolist() == [-1, -1, 0, -1, 2]
    plain = Window(None, np.array([1, 1, 1, 2, 2]))
    assert plain.least_before(np.array([-1, 3, -2, 4, 1])).tolist() == [0, -1, -1, 0, 4]


@pytest.mark.parametrize("text", ["", "--[==[ a ]] ]==] x", "[[ a ] ]]b", "[==[ open", '"a\\z\n b" c', "function f<T>(x: ((((T))))) return x end", "x =\u0085 'é😀'\r\n"])
def test_matches_are_those_of_the_session(spark, text):
    """The patterns are Java's; Python's matches must be the same, and add up to the text."""
    frame = spark.createDataFrame([(text,)], "content string")
    for java, pattern in ((lx.TOKEN_LEX, px.TOKENS), (lx.SCAN_LEX, px.SCANNED)):
        got = [m[:2] for m in pattern.findall(text)]
        raw, core = frame.select(*[F.regexp_extract_all("content", F.lit(java), F.lit(i)) for i in (0, 1)]).first()
        assert got == list(zip(raw, core, strict=True))
        assert "".join(g[0] for g in got) == text


def test_steps_are_derived_without_windows_over_rows(units_of):
    units = units_of({"a": "function f(x)\n\tif x then\n\t\tg()\n\tend\nend\n"})
    plan = plan_of(o.steps(units))
    assert "Window" not in plan and "MapInArrow" in plan


def test_steps_come_as_they_stand_in_the_file(units_of):
    text = "function f(x)\n\tif x then\n\t\tg()\n\tend\n\th()\nend\nfunction k() m() end\n"
    assert [r.line for r in o.steps(units_of({"a": text})).collect()] == [2, 3, 5, 7]


def test_batches_hold_whole_files():
    batch = pa.RecordBatch.from_pydict({"unit_id": ["a", "b", "b", None, None, "c"], "content": ["xx", "x", None, "x", "x", "xxx"]})
    got = list(bx.batches_of_files(iter([batch.slice(0, 2), batch.slice(2)]), limit=1))
    assert got == [(["a"], ["xx"]), (["b", "b", None, None], ["x", None, "x", "x"]), (["c"], ["xxx"])]


def test_a_file_in_many_batches_of_others(units_of):
    text = "function {0}(x)\n\twhile true do\n\t\tgo(function(p)\n\t\t\treturn a_long_text + another_long_text_that_goes_on_and_on(p)\n\t\tend)\n\tend\nend\n"
    texts = {f"u{i}": text.format(f"f{i}") for i in range(40)}
    rows = o.outline(units_of(texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.unit_id, []).append((r.fn_name == f"f{r.unit_id[1:]}", r.kind, r.step_no, r.sub_end, r.parent_no, r.label or r.condition, r.line))
    first = sorted(by["u0"], key=str)
    assert len(by) == 40 and all(sorted(v, key=str) == first for v in by.values())
    assert [k for _, k, *_ in first].count("closure") == 1 and all(named for named, *_ in first)


ODD = {
    "a": "-- c\nlocal x, y: Map<T, {U}> = 1, 'é\nfunction a.b:c(d)\n  local function e() end\n  do f[1](`{`) end\nend\nfunction\nfoo.\n end end",
    "b": "then if x then y else if z then 1 else 2 end\nexport type P<T> = { a: T }\nfunction f<T>(x: ((((T))))) g(function() end) )",
    "c": "repeat until x if a then elseif b then end function . f() \"open\\",
}


def test_operators_over_tokens_need_no_windows_over_rows(units_of):
    tokens = lexing.tokens(units_of(ODD))
    for df in (tokens, blocks.block_depth(tokens), blocks.block_pairs(tokens), diagnostics.problems(tokens), elements.elements(units_of(ODD)),
               outcomes.job_report(units_of(ODD))):
        assert "Window" not in plan_of(df)


@pytest.mark.parametrize("of", [blocks.block_depth, blocks.block_pairs, diagnostics.problems])
def test_a_table_of_tokens_gives_the_same_rows(units_of, of):
    """Tokens from elsewhere are passed over by windows, tokens of files in batches."""
    tokens = lexing.tokens(units_of(ODD))
    batches, windows = of(tokens), of(tokens.select("*"))
    assert "Window" not in plan_of(batches) and "Window" in plan_of(windows)
    assert batches.dtypes == windows.dtypes
    assert sorted(map(str, batches.collect())) == sorted(map(str, windows.collect()))


def test_elements_of_odd_texts(units_of):
    got = [tuple(r)[1:] for r in elements.elements(units_of(ODD)).orderBy("unit_id", "elem_no").collect() if r.unit_id == "a"]
    assert got == [
        (1, "constant", "x", 2, 0, None, "local x"), (2, "constant", "y", 2, 0, None, "local y"),
        (3, "function", "a.b:c", 3, 0, None, "function a.b:c(d)"), (4, "local_function", "e", 4, 2, "a.b:c", "local function e()"),
    ]


def test_rules_over_steps_need_no_windows_over_rows(units_of):
    outlined = o.outline(units_of({"a": "function f(x)\n\twhile true do\n\t\twait(1)\n\tend\nend\n"}))
    found = rules.findings(o.steps_of(outlined), o.functions_of(outlined))
    assert "Window" not in plan_of(found)
    assert sorted((r.rule, r.step_no) for r in found.collect()) == [("deprecated-api", 1), ("infinite-loop", 0), ("wait-in-loop", 1)]


def test_batches_hold_whole_functions():
    rows = [("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 1), ("b", 1), (None, 1)]
    batch = pa.RecordBatch.from_pydict({"unit_id": [u for u, _ in rows], "fn_no": [n for _, n in rows]})
    got = [t.num_rows for t, _ in bf.whole_functions((batch.slice(i, 1) for i in range(len(rows))), limit=2)]
    assert got == [3, 5]  # a function goes on past the limit


def test_a_pattern_ends_where_java_ends():
    assert [px.strip(t) for t in ("\t a b \n", " \u00e9 \u0085", " a ")] == ["a b", "\u00e9\u0085", "a"]
    assert px.java("b$").search("ab\r\n") and px.java("b$").search("ab\u2028") and not px.java("b$").search("ab\n\n")


def test_tokens_of_pieces_store_no_lexemes(spark, units_of, monkeypatch):
    """Only the text and narrow columns are written; no window passes over tokens."""
    written = {}

    def write(df, name):
        written[name] = df.columns
        return df.localCheckpoint()

    monkeypatch.setattr(pieces, "write_stage", write)
    units = units_of({"a": "local a = [==[ x\n\n ]] y\n ]==] .. b\n--[[ c\n d ]] e = 1\n  f()\n"})
    got = pieces.tokens(units, 4)
    assert written["lexed_pieces"] == ["unit_id", "piece", "owner", "part", "count"]
    assert written["entry_modes"] == ["unit_id", "piece", "head", "owner"]
    assert sorted(map(str, got.collect())) == sorted(map(str, lexing.tokens(units).collect()))


@pytest.mark.parametrize("rule", rules.RULE_NAMES)
def test_a_rule_alone_finds_what_it_finds_among_all(rule, outlined):
    """Alone it gets the columns that it reads, and no others."""
    steps, functions, every = outlined
    alone = rules.findings(steps, functions, 2, 3, rules=[rule]).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in every if r.rule == rule) and alone


@pytest.fixture(scope="module")
def outlined(units_of):
    from lumenscan.sources.snippets import SNIPPETS

    more = "for i = 1, 2 do\nfor j = 1, 2 do\nfor k = 1, 2 do\n" + "\n".join(SNIPPETS[:20] + SNIPPETS[20:]) + "\nend\nend\nend"
    body = "\n".join([*SNIPPETS, more, "go(x)\ngo(x)", "if a then\nb()\nend\nif a then\nc()\nend", "call(function() return 1 end, function() return 2 end)"])
    table = o.outline(units_of({"a": f"function f(x)\n{body}\nend\nfunction g() end\nfunction h()\nx:Connect(y)\nend\n"})).localCheckpoint()
    steps, functions = o.steps_of(table), o.functions_of(table)
    return steps, functions, rules.findings(steps, functions, 2, 3).collect()

"""Sources that once lost functions, statements or the whole job."""

import re
from collections import Counter

import pytest

from lumenscan.operators import diagnostics, elements, lexing
from lumenscan.operators import outline as o
from lumenscan.plans import outcomes

FORMS = '''function M.p<T, U...>(a: (((((number))))), b: Map<T, {U}>)
  if x then return end wait(1)
  foo() while true do end bar()
  local y = if x then if z then 1 else 2 else 3
  local a,
    b = 1, 2
  local t: {
    n: Map<string, Array<Map<number, X>>>
  } = {}
  local c
  obj
    :go()
    :stop()
  local s = "a\\z
     b" local k = `a {f(`end`)} b`
  while i < 3 do i += 1 end repeat j() until done
  local w: Array<number>
  if p then q() elseif r then s() else u() end v()
  return a + b
end
local function q(x --[[ a
 b ]], y) return x end
function N.deep(a: ((((((((((number)))))))))) ) go() end
'''


@pytest.fixture(scope="module")
def units(units_of):
    return units_of({"forms": FORMS})


def test_no_function_and_no_statement_is_lost(units):
    rows = o.outline(units).collect()
    names = [r["fn_name"] for r in sorted(rows, key=lambda r: r["fn_no"]) if r["kind"] == "function"]
    assert names == ["M.p", "q", "N.deep"]
    first = sorted((r for r in rows if r["fn_no"] == 0 and r["kind"] != "function"), key=lambda r: r["step_no"])
    assert [r["label"] or r["condition"] for r in first] == [
        "x", "return", "wait(1)", "foo()", "true", "bar()", "local y = if x then if z then 1 else 2 else 3", "local a, b = 1, 2",
        "local t: { n: Map<string, Array<Map<number, X>>> } = {}", "local c", "obj :go() :stop()", 'local s = "a\\z b"',
        "local k = `a {f(`end`)} b`", "i < 3", "i += 1", "done", "j()", "local w: Array<number>", "p", "q()", "r", "s()", "u()", "v()", "return a + b",
    ]


def test_every_word_of_a_body_is_in_exactly_one_step(units):
    words = lambda text: Counter(re.findall(r"\w+", text))
    rows = [r for r in o.outline(units).collect() if r["kind"] != "function"]
    in_steps = words(" ".join(r[c] for r in rows for c in ("label", "condition", "header") if r[c]))
    body = re.sub(r"--\[\[.*?\]\]", "", FORMS, flags=re.S)
    body = re.sub(r"(?m)^(local )?function [^\n]*?\)(?= return| go|$)", "", re.sub(r"\(x\s+, y\)", "(x, y)", body))
    blocks = Counter(("end", "if", "then", "else", "elseif", "while", "do", "repeat", "until"))
    in_body = words(body)
    for word in set(in_steps | in_body) - set(blocks):
        assert in_steps[word] == in_body[word], word


def test_bindings_over_lines(units):
    rows = elements.elements(units).collect()
    got = {r["name"]: r["kind"] for r in rows}
    assert got == {
        "M.p": "function", "N.deep": "function", "q": "local_function", "y": "constant", "a": "constant", "b": "constant", "t": "constant",
        "c": "variable", "s": "constant", "k": "constant", "w": "variable",
    }
    assert len(rows) == len(got) and "" not in got


def test_no_false_diagnostics(units):
    assert diagnostics.diagnostics(lexing.tokens(units)).collect() == []


@pytest.mark.parametrize("piece", ["\\1", "\\z\n", 'a\\"', "{"])
def test_strings_of_any_length(units_of, piece):
    long = units_of({"closed": f'local s = "{piece * 1_000_000}"\nfunction p() go() end\n', "open": 'local s = "' + "\\1" * 300_000 + "\nx = 1\n"})
    rows = {r["unit_id"]: r for r in outcomes.outcomes(long).collect()}
    assert rows["closed"]["diagnostic_count"] == 0 and rows["open"]["diagnostic_count"] == 1
    assert [r["label"] for r in o.steps(long).collect()] == ["go()"]
    assert elements.elements(long).count() == 3


def test_short_closures_can_be_steps(units_of):
    short = units_of({"u": "function p()\n  run(function() go() end)\nend\n"})
    assert [r["kind"] for r in o.steps(short).collect()] == ["action"]
    assert [r["kind"] for r in o.steps(short, min_closure_chars=0).orderBy("step_no").collect()] == ["closure", "action"]


def test_statuses_equal_those_of_outcomes(units_of):
    mixed = units_of({"good": FORMS, "bad": "function p( end\n", "empty": ""})
    want = {r["unit_id"]: r["status"] for r in outcomes.outcomes(mixed).collect()}
    assert {r["unit_id"]: r["status"] for r in outcomes.statuses(mixed).collect()} == want
    assert want == {"good": "succeeded", "bad": "succeeded_with_diagnostics", "empty": "succeeded"}

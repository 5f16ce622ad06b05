"""Every lexeme has one owner, and what nobody owns is a problem."""

import pytest

from lumenscan.operators import diagnostics, lexing, ownership
from lumenscan.plans import outcomes

TEXTS = {
    "clean": "local M = {}\nfunction M.a<T = (U) -> U>(x: ((((T)))))\n  run(function(p)\n    local q = x + p + something.long\n    return use(q, p)\n  end, 1)\n"
             "  if x then go(); stop() end\n  repeat x -= 1 until x < 0\nend\nreturn M\n",
    "no header": "function foo end\nfunction good() go() end\n",
    "unclosed generic": "function g<T end\nfunction good() go() end\n",
    "unclosed block": "function good() go() end\nwhile x do\n",
    "stray bracket": "function good()\n  )\n  go()\nend\n",
    "comment only": "-- nothing\n",
}


@pytest.fixture(scope="module")
def units(units_of):
    return units_of(TEXTS)


def test_lexemes_add_up_to_the_file_and_have_known_owners(units):
    got = {r.unit_id: r for r in ownership.ownership_counts(units).collect()}
    assert {u: r.n_chars for u, r in got.items()} == {u: len(t) for u, t in TEXTS.items()}
    assert {u: r.n_unowned for u, r in got.items()} == {
        "clean": 0, "no header": 1, "unclosed generic": 1, "unclosed block": 1, "stray bracket": 2, "comment only": 0,
    }
    owners = {r.owner for r in ownership.ownership(units).collect()}
    assert owners <= set(ownership.OWNERS) and "nobody" in owners


def test_what_nobody_owns_is_a_problem_at_its_line(units):
    got = sorted(((r.unit_id, r.message, r.line) for r in ownership.unowned(units).collect()), key=lambda r: (r[0], r[2]))
    assert [(u, line) for u, _, line in got] == [("no header", 1), ("stray bracket", 2), ("stray bracket", 3), ("unclosed block", 2), ("unclosed generic", 1)]
    assert [m for u, m, _ in got if u == "stray bracket"] == ["belongs to no statement ')'", "belongs to no statement 'go()'"]


def problems_of(units_of, text):
    rows = diagnostics.diagnostics(lexing.tokens(units_of({"u": text}))).collect()
    return sorted((r.line, r.col, r.message) for r in rows)


NONE = "no header behind 'function'"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("function foo end", [(1, 0, NONE)]),
        ("x = 1\n  function a b(c) end", [(2, 2, NONE)]),
        ("function a.(c) end", [(1, 0, NONE)]),
        ("function .a(c) end", [(1, 0, NONE)]),
        ("function a..b(c) end", [(1, 0, NONE)]),
        ("function a = 1 end", [(1, 0, NONE)]),
        ("function a.b:c(d) end local f = function(x) end function g<T>(x) end", []),
        ("function --[[ c ]] a --[[ d ]] . b\n(c) end", []),
        ("function a end function b end", [(1, 0, NONE), (1, 15, NONE)]),
    ],
)
def test_functions_without_a_header(units_of, text, want):
    assert problems_of(units_of, text) == want


def test_outcome_of_a_function_without_a_header(units_of):
    (row,) = outcomes.outcomes(units_of({"u": "function foo end\n"})).collect()
    assert (row.status, row.diagnostic_count, row.token_count) == ("succeeded_with_diagnostics", 1, 3)

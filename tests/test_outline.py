"""Functions and steps from source text."""

import pytest

from lumenscan.operators import outline as o

SOURCES = {
    "any": "function area(w, h): any\n  return (w * h) / (scale + 1)\nend",
    "optional": "function pick(key: number): Slot?\n  return slots[key]\nend",
    "tuple": "function halves(n): (number, { string })\n  return n / 2, {}\nend",
    "one line typed": "function f(x: number): number return x end",
    "elseif": "function tier(k)\n  if k == red then\n    stop()\n  elseif k == amber then\n    slow()\n  else\n    go()\n  end\nend",
    "no else": "function tier(k)\n  if k == red then\n    stop()\n  elseif k == amber then\n    slow()\n  end\nend",
    "do": "function p()\n  do\n    open(file)\n    do\n      local n = size(file)\n    end\n  end\n  close(file)\nend",
    "colon": "local Door = {}\nfunction Door:shut(hard)\n  return hard\nend\nreturn Door",
    "pcall": "function p(order)\n  local fine, bill = pcall(function()\n    local sum = total(order)\n    local tax = levy(sum, region)\n"
             "    return sum + tax\n  end)\n  send(bill)\nend",
    "short closure": "function p(names)\n  each(names, function(n)\n    seen[n] = true\n  end)\n  done(names)\nend",
    "broken": "local Q = {}\nfunction Q.open(\nend\nreturn Q",
    "two-line if": "function p()\n  if a and\n     b then\n    go()\n  end\nend",
    "table": "function p()\n  local t = {\n    a = 1,\n    b = { 2, 3 },\n  }\n  return t\nend",
    "value if": "function p()\n  local x = if a then 1 else 2\n  local y = if a\n    then 1\n    else 2\n  return if x then y else if z then 1 else 2\nend",
    "trap": 'function p()\n  local s = "end" -- end\n  local l = [[ end\n if then ]]\n  --[==[ end\n ]] ]==]\n  return s\nend',
    "unterminated": 'function p()\n  local s = "end\n  return s\nend',
    "semicolons": "function p()\n  a(); b();\n  if x then c() end; d()\nend",
    "nested": "function outer()\n  local function inner(value)\n    local doubled = value * 2\n    local tripled = value * 3\n"
              "    return doubled + tripled\n  end\n  return inner(1)\nend\nfunction last() end",
    "in anonymous": "foo.bar = function()\n  local function inner(z)\n    return z\n  end\nend",
    "generic": "function id<T>(x: T): T\n  return x\nend\nfunction after() return 1 end",
    "repeat": "function p()\n  repeat\n    local x = next()\n  until x == nil or\n    done\n  return 1\nend",
    "loops": "function p()\n  for i = 1, 10, 2 do end\n  for k, v in pairs(t) do\n    for i = #t, 1, -1 do use(i) end\n  end\n  while f(x) do g() end\nend",
    "second function": "function p()\n  xpcall(function()\n    work()\n  end, function(err)\n    local text = describe(err, 1)\n    report(text)\n    store(text, err)\n  end)\nend",
    "function in header": "function p()\n  for _, x in ipairs(map(list, function(v)\n    return transform(v, options.first, options.second, options.third)\n  end)) do\n    use(x)\n  end\nend",
    "empty": "",
    "only comment": "-- nothing\n",
}


@pytest.fixture(scope="module")
def table(spark, units_of):
    rows = o.outline(units_of(SOURCES)).collect()
    return [r.asDict() for r in rows]


@pytest.fixture(scope="module")
def steps(table):
    def of(unit):
        rows = [r for r in table if r["unit_id"] == unit and r["kind"] != "function"]
        return sorted(rows, key=lambda r: (r["fn_no"], r["step_no"]))

    return of


@pytest.fixture(scope="module")
def functions(table):
    def of(unit):
        rows = [r for r in table if r["unit_id"] == unit and r["kind"] == "function"]
        return sorted(rows, key=lambda r: r["fn_no"])

    return of


def texts(rows):
    return [r["label"] or r["condition"] or r["header"] for r in rows]


def shape(rows):
    return [(r["parent_no"], r["branch"], r["ordinal"], r["kind"]) for r in rows]


@pytest.mark.parametrize(
    ("unit", "want"),
    [
        ("any", ["return (w * h) / (scale + 1)"]),
        ("optional", ["return slots[key]"]),
        ("tuple", ["return n / 2, {}"]),
        ("one line typed", ["return x"]),
        ("do", ["open(file)", "local n = size(file)", "close(file)"]),
        ("two-line if", ["a and b", "go()"]),
        ("table", ["local t = { a = 1, b = { 2, 3 }, }", "return t"]),
        ("value if", ["local x = if a then 1 else 2", "local y = if a then 1 else 2", "return if x then y else if z then 1 else 2"]),
        ("trap", ['local s = "end"', "local l = [[ end if then ]]", "return s"]),
        ("unterminated", ['local s = "end', "return s"]),
        ("semicolons", ["a()", "b()", "x", "c()", "d()"]),
        ("repeat", ["x == nil or done", "local x = next()", "return 1"]),
        ("loops", ["i = 1, 10, 2", "k, v in pairs(t)", "i = #t, 1, -1", "use(i)", "f(x)", "g()"]),
    ],
)
def test_texts(steps, unit, want):
    assert texts(steps(unit)) == want


def test_elseif_nests_in_else(steps):
    assert shape(steps("elseif")) == [
        (None, "body", 0, "if"), (0, "then", 0, "action"), (0, "else", 0, "if"), (2, "then", 0, "action"), (2, "else", 0, "action"),
    ]
    assert [(r["sub_end"], r["n_then"], r["n_else"]) for r in steps("elseif")[::2]] == [(4, 1, 1), (4, 1, 1), (4, 0, 0)]


def test_elseif_without_else(steps):
    rows = steps("no else")
    assert [r["n_else"] for r in rows if r["kind"] == "if"] == [1, 0]


def test_loop_kinds(steps):
    assert [r["kind"] for r in steps("loops")] == ["numeric_for", "for_in", "numeric_for", "action", "while", "action"]
    assert [r["n_body"] for r in steps("loops")][:2] == [0, 1]


def test_long_closure_becomes_a_step(steps):
    first = steps("pcall")[0]
    assert (first["kind"], first["label"], first["signature"], first["n_body"]) == (
        "closure", "local fine, bill = pcall( {...}", "function()", 3,
    )
    assert texts(steps("pcall"))[1:] == ["local sum = total(order)", "local tax = levy(sum, region)", "return sum + tax", "send(bill)"]


def test_short_closure_stays_text(steps):
    assert texts(steps("short closure")) == ["each(names, function(n) seen[n] = true end)", "done(names)"]


def test_only_the_first_function_of_a_statement_counts(steps):
    assert [r["kind"] for r in steps("second function")] == ["action"]


def test_function_in_a_loop_header_stays_text(steps):
    assert [r["kind"] for r in steps("function in header")] == ["for_in", "action"]


def test_nested_local_function(steps, functions):
    rows = steps("nested")
    assert [f["fn_name"] for f in functions("nested")] == ["outer", "last"]
    assert (rows[0]["kind"], rows[0]["label"], rows[0]["signature"]) == ("closure", "local {...}", "local function inner(value)")
    assert texts(rows)[-1] == "return inner(1)"


def test_named_function_inside_an_anonymous_one(steps, functions):
    assert [(f["fn_name"], f["signature"]) for f in functions("in anonymous")] == [("inner", "local function inner(z)")]
    assert texts(steps("in anonymous")) == ["return z"]


def test_names_and_containers(spark, units_of):
    source = "function a.b.c(x) end\nfunction a.b:d() end\nfunction M:e() end\nlocal\nfunction f() end\nfunction g ( y ,\n z ) end"
    rows = o.functions(units_of({"u": source})).orderBy("fn_no").collect()
    assert [(r["fn_name"], r["container"]) for r in rows] == [
        ("a.b.c", "a.b"), ("a.b:d", "a"), ("M:e", "M"), ("f", None), ("g", None),
    ]
    assert rows[3]["signature"] == "function f()"
    assert rows[4]["signature"] == "function g ( y , z )"


def test_rejected_headers(functions):
    assert functions("broken") == []
    assert [f["fn_name"] for f in functions("generic")] == ["id", "after"]


def test_files_without_functions(table):
    assert not [r for r in table if r["unit_id"] in ("empty", "only comment")]


def test_intervals_nest(table):
    """Every subtree is the step plus its children's subtrees."""
    by_fn = {}
    for r in table:
        if r["kind"] != "function":
            by_fn.setdefault((r["unit_id"], r["fn_no"]), []).append(r)
    for rows in by_fn.values():
        assert sorted(r["step_no"] for r in rows) == list(range(len(rows)))
        for r in rows:
            below = [d for d in rows if d["parent_no"] == r["step_no"]]
            assert len(below) == r["n_then"] + r["n_else"] + r["n_body"]
            assert r["sub_end"] == max([r["step_no"], *[d["sub_end"] for d in below]])


def test_the_pipeline_shuffles_once(spark, units_of):
    plan = o.steps(units_of(SOURCES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

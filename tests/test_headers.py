"""Function headers that nest and span as they like, against hand-written steps, and a plain search for their ends."""

import pytest

from lumenscan.operators import elements, rules
from lumenscan.operators import outline as o

LOOP = "  while true do go() end\n"
#: unit -> text, names, signature of the first function, first steps
FORMS = {
    "function type as a default": (f"function M.g<T = (number) -> string>(x)\n{LOOP}end\n", ["M.g"], "function M.g<T = (number) -> string>(x)"),
    "generics over lines": (f"function M.g<\n  T,\n  U\n>(x)\n{LOOP}end\n", ["M.g"], "function M.g< T, U >(x)"),
    "deep generics": (f"function M.g<T = A<B<C<D<E<F>>>>>>(x)\n{LOOP}end\n", ["M.g"], "function M.g<T = A<B<C<D<E<F>>>>>>(x)"),
    "long comment": (f"function M.c(a --[====[ x ) ]====],\n b)\n{LOOP}end\n", ["M.c"], "function M.c(a --[====[ x ) ]====], b)"),
    "deep brackets": (f"function M.p(a: {'(' * 200}number{')' * 200})\n{LOOP}end\n", ["M.p"], f"function M.p(a: {'(' * 200}number{')' * 200})"),
    "generic default with generics": (f"function M.h<T = <U>(U) -> U>\n (x: T)\n{LOOP}end\n", ["M.h"], "function M.h<T = <U>(U) -> U> (x: T)"),
    "arrow behind arrow": (f"function M.k(f: <K>(K, (((K)))) -> (), g: {{[string]: {{x: {{y: {{z: T}}}}}}}})\n{LOOP}end\n", ["M.k"],
                           "function M.k(f: <K>(K, (((K)))) -> (), g: {[string]: {x: {y: {z: T}}}})"),
    "type over lines": (f"function M.r(a): {{\n  b: {{ c: {{ d: number }} }},\n}}\n{LOOP}end\n", ["M.r"], "function M.r(a)"),
    "signs in strings": (f"function M.s<T = \"a>(b\" | '<'>(x: \")\")\n{LOOP}end\n", ["M.s"], "function M.s<T = \"a>(b\" | '<'>(x: \")\")"),
    "comment in front": (f"function --[[ a ]] M.q --[=[ b ]=] (x)\n{LOOP}end\n", ["M.q"], "function --[[ a ]] M.q --[=[ b ]=] (x)"),
    "two of them": (f"function a<T = (U) -> U>(x)\n{LOOP}end\nfunction b(x: (((((U))))))\n{LOOP}end\n", ["a", "b"], "function a<T = (U) -> U>(x)"),
    "local": (f"local function l<T = A<B>>(x: ((((T)))))\n{LOOP}end\n", ["l"], "local function l<T = A<B>>(x: ((((T)))))"),
}


@pytest.fixture(scope="module")
def units(units_of):
    return units_of({name: text for name, (text, *_) in FORMS.items()})


@pytest.fixture(scope="module")
def table(units):
    return [r.asDict() for r in o.outline(units).collect()]


@pytest.mark.parametrize("name", FORMS)
def test_header_gives_its_function_and_steps(table, name):
    _, names, signature = FORMS[name]
    mine = sorted((r for r in table if r["unit_id"] == name), key=lambda r: (r["fn_no"], r["step_no"] is not None, r["step_no"] or 0))
    assert [r["fn_name"] for r in mine if r["kind"] == "function"] == names
    assert mine[0]["signature"] == signature
    steps = [(r["kind"], r["condition"] or r["label"]) for r in mine if r["kind"] != "function"]
    assert steps == [("while", "true"), ("action", "go()")] * len(names)


def test_headers_are_elements_and_have_findings(spark, units):
    found = {(r.unit_id, r.name): r.signature for r in elements.elements(units).collect()}
    outlined = o.outline(units)
    loops = {r.unit_id for r in rules.findings(o.steps_of(outlined), o.functions_of(outlined), rules=("infinite-loop",)).collect()}
    assert loops == set(FORMS)
    for unit, (_, names, signature) in FORMS.items():
        assert found[unit, names[0]] == signature


def test_statements_behind_a_header_on_its_line(units_of):
    texts = {
        "plain": "function f(a: (((((T)))))) go() end",
        "generic": "function f<T = (U) -> U>(x) go() end",
        "compared": "function f<T = (U) -> U>(x) go() y = a > (b) end",
    }
    rows = o.steps(units_of(texts)).orderBy("unit_id", "step_no").collect()
    assert [(r.unit_id, r.label) for r in rows] == [("compared", "go() y = a > (b)"), ("generic", "go()"), ("plain", "go()")]


@pytest.mark.parametrize("text", ["function foo end", "function Q.open(\nend\nreturn Q", "function g<T end", "function h<T = (U\nlocal x = 1\nend", "function"])
def test_no_header_takes_nothing_along(units_of, text):
    rows = o.outline(units_of({"u": f"{text}\nfunction good(x)\n{LOOP}end\n"})).collect()
    assert "good" in {r["fn_name"] for r in rows} or text == "function Q.open(\nend\nreturn Q"
    assert not {r["fn_name"] for r in rows} - {"good"}


def test_offsets_go_on_behind_a_header(units_of):
    text = "\n\nfunction a<\n T\n>(x)\n" + LOOP + "end\nfunction b()\n go(1)\nend\n"
    rows = {r["fn_name"]: r for r in o.outline(units_of({"u": text})).collect() if r["kind"] == "function"}
    assert (rows["a"]["line"], rows["b"]["line"]) == (3, 8)
    assert text[rows["b"]["start"] :].startswith("function b") and text[rows["b"]["stop"] :].startswith("end")

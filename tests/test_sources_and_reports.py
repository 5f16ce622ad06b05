"""Files in, outcomes and reports out."""

import json

import pytest
from pyspark.sql import functions as F

from lumenscan.operators import context, elements, rules
from lumenscan.plans import outcomes, reports
from lumenscan.plans.analysis import Analysis
from lumenscan.session import write_stage
from lumenscan.sources import files
from lumenscan.sources.corpus import corpus_lines, script_corpus
from lumenscan.verification import trees as t
from lumenscan.verification.trees import act, closure, loop_in, when

SF = "/root/testdata/sf0.001"
GOOD = "local M = {}\nfunction M.run(x)\n  if x then\n    wait(1)\n  end\nend\nfunction M.none() end\nreturn M\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    (root / "sub").mkdir()
    (root / "good.luau").write_text(GOOD, encoding="utf-8")
    (root / "sub" / "clean.lua").write_text("local function f(x) return x end\n", encoding="utf-8")
    (root / "sub" / "bad.luau").write_bytes(b"local x = \xff\xfe")
    (root / "notes.txt").write_text("no source", encoding="utf-8")
    return root


@pytest.fixture(scope="module")
def units(spark, tree):
    return write_stage(files.read_source_tree(spark, str(tree)), "units")


def by_name(rows):
    return {r["location"].rsplit("/", 1)[-1]: r for r in rows}


def test_tree_reads_both_suffixes_below(units):
    rows = by_name(units.collect())
    assert set(rows) == {"good.luau", "clean.lua", "bad.luau"}
    assert rows["good.luau"]["content"] == GOOD
    assert (rows["bad.luau"]["valid_utf8"], rows["bad.luau"]["content"]) == (False, None)


def test_one_file(spark, tree):
    row = files.read_source(spark, str(tree / "good.luau")).first()
    assert row["content"] == GOOD
    assert row["location"] == str(tree / "good.luau")


def test_refused_inputs(spark, tree, tmp_path):
    with pytest.raises(ValueError, match="expected a .luau or .lua file"):
        files.read_source(spark, str(tree / "notes.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_source(spark, str(tree / "missing.luau"))
    with pytest.raises(ValueError, match="no .luau/.lua files"):
        files.read_source_tree(spark, str(tmp_path))


def test_one_bad_file_fails_alone(units):
    rows = by_name(outcomes.outcomes(units).collect())
    assert {n: r["status"] for n, r in rows.items()} == {
        "good.luau": "succeeded", "clean.lua": "succeeded", "bad.luau": "technical_failure",
    }
    assert (rows["bad.luau"]["token_count"], rows["bad.luau"]["diagnostic_count"]) == (0, 1)
    assert rows["good.luau"]["element_count"] == 3


def test_job_report(units):
    rows = {r["source_location"].rsplit("/", 1)[-1]: r for r in outcomes.job_report(units).collect()}
    assert [e["name"] for e in rows["good.luau"]["structural_elements"]] == ["M", "M.run", "M.none"]
    assert [(d["line"], d["col"]) for d in rows["bad.luau"]["diagnostics"]] == [(0, 0)]
    assert rows["clean.lua"]["statistics"]["structural_element_count"] == 1
    summary = outcomes.job_summary(outcomes.outcomes(units)).first()
    assert (summary["source_count"], summary["succeeded_count"], summary["technical_failure_count"]) == (3, 2, 1)


def test_job_invariants(units):
    done = outcomes.outcomes(units).select("unit_id")
    assert outcomes.job_invariants(units, done).count() == 0
    assert [r["violation"] for r in outcomes.job_invariants(units.limit(0), done.limit(0)).collect()] == ["empty job"]
    twice = units.unionByName(units)
    assert {r["violation"] for r in outcomes.job_invariants(twice, done).collect()} == {"duplicate unit"}


def test_reports(units, tmp_path):
    a = Analysis(units)
    report = reports.file_report(a.units, a.findings)
    rows = by_name(report.collect())
    assert [s["rule"] for s in rows["good.luau"]["smells"]] == ["deprecated-api", "empty-function"]
    assert (rows["clean.lua"]["smell_count"], rows["clean.lua"]["smells"]) == (0, [])
    total = reports.corpus_report(a.units, a.findings).first()
    assert (total["file_count"], total["total_smells"], total["warning"], total["info"]) == (3, 2, 1, 1)
    index = by_name(reports.function_index(a.units, a.functions).collect())
    assert index["good.luau"]["function_names"] == ["M.run", "M.none"]
    assert index["clean.lua"]["output_name"].endswith("clean.nassi.html")
    files.write_report(reports.report_json(report), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text("utf-8").splitlines()]
    good = next(x for x in lines if x["source_location"].endswith("good.luau"))
    assert good["summary"] == {"error": 0, "warning": 1, "info": 1}
    assert good["smells"][0]["line"] is None
    assert "line" in good["smells"][0]


ELEMENTS = """local a, b = 1, 2
local n
local t: { x: number, y: (string) -> number }, u = nil, 3
type Id<T> = T
export type Pair = { a: Id }
local f = function()
  local hidden = 1
end
function M.outer(x)
  local inside
  function M.deep()
    function M.deeper() local z = 1 end
    local w = 2
  end
  call(function() local seen = 1 end)
  local function g() local gone = 1 end
end
  local last = 1
"""


def test_elements(units_of):
    rows = elements.elements(units_of({"u": ELEMENTS})).orderBy("elem_no").collect()
    assert [(r["kind"], r["name"], r["container"]) for r in rows] == [
        ("constant", "a", None), ("constant", "b", None), ("variable", "n", None), ("constant", "t", None),
        ("constant", "u", None), ("type_alias", "Id", None), ("type_alias", "Pair", None), ("constant", "f", None),
        ("function", "M.outer", None), ("variable", "inside", "M.outer"), ("function", "M.deep", "M.outer"),
        ("function", "M.deeper", "M.outer.M.deep"), ("constant", "z", "M.outer.M.deep.M.deeper"),
        ("constant", "w", "M.outer.M.deep"), ("constant", "seen", "M.outer"), ("local_function", "g", "M.outer"),
        ("constant", "last", None),
    ]
    assert (rows[-1]["line"], rows[-1]["col"]) == (18, 2)
    assert rows[-2]["signature"] == "local function g()"


TREE = {
    "f": [
        when("a", [loop_in("b", closure("c {...}", act("return 1")))], [when("type(x)", [act("y()")])]),
        act("z()"),
    ],
    "g": [loop_in("b")],
}


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(t.step_rows(TREE), t.STEP_DDL)


def test_context(steps):
    rows = context.step_context(steps).filter("fn_no = 0").orderBy("step_no").collect()
    got = [(r["if_depth"], r["loop_depth"], r["closure_depth"], r["in_loop"]) for r in rows]
    assert got == [
        (0, 0, 0, False), (1, 0, 0, False), (1, 1, 0, True), (1, 1, 1, True), (1, 0, 0, False), (2, 0, 0, False), (0, 0, 0, False),
    ]
    assert [r["step_no"] for r in context.exits(steps).orderBy("step_no").collect()] == [0, 1, 2]
    assert [r["step_no"] for r in context.type_checks(steps).collect()] == [0]
    assert {r["fn_name"]: r["max_depth"] for r in context.max_depth(steps).collect()} == {"f": 3, "g": 1}
    assert {r["fn_name"]: r["n_steps"] for r in context.total_steps(steps).collect()} == {"f": 7, "g": 1}


def test_read_steps_finds_subtree_ends(steps):
    want = {(r["fn_no"], r["step_no"]): r["sub_end"] for r in steps.collect()}
    got = files.read_steps(steps.drop("sub_end")).collect()
    assert {(r["fn_no"], r["step_no"]): r["sub_end"] for r in got} == want
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_steps(steps.drop("label"))


def test_findings_shuffle_a_step_table_once(spark, steps):
    written = write_stage(steps, "steps")
    plan = rules.findings(written, None, rules=["unreachable", "infinite-loop", "identical-actions"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_files_do_not_depend_on_the_size_of_a_customer(spark):
    one, three = (corpus_lines(spark, SF, n) for n in (1, 3))
    assert script_corpus(spark, SF, 3).count() > script_corpus(spark, SF, 1).count()
    assert one.count() == three.count() and one.filter("shard > 0").isEmpty()
    assert three.filter(F.col("shard") != F.floor(F.col("l_orderkey") / 3 % 3)).isEmpty()


def test_a_written_report_is_in_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("n"))
    files.write_report(rows, str(tmp_path / "r"), order_by=["n"], parts=4)
    parts = sorted((tmp_path / "r").glob("part-*"))
    assert len(parts) > 1
    assert [int(n) for p in parts for n in __import__("re").findall(r"\d+", p.read_text())] == list(range(500))


def test_a_given_sub_end_is_not_trusted(steps):
    wrong = steps.withColumn("sub_end", F.lit(-1))
    got = {(r["fn_no"], r["step_no"]): r["sub_end"] for r in files.read_steps(wrong).collect()}
    assert got == {(r["fn_no"], r["step_no"]): r["sub_end"] for r in steps.collect()}

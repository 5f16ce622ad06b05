"""Files listed and read by executors, and the order of the input in reports."""

import json

import pytest
from pyspark.sql import functions as F

from lumenscan.plans import outcomes, reports
from lumenscan.plans.analysis import Analysis
from lumenscan.plans.ordinals import with_ordinal
from lumenscan.sources import files, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in {
        "a.lua": b"local x = 1\n", "b/c/d/e.luau": b"return 1\n", "b/bad.luau": b"\xff", "b/empty.lua": b"", "_under/_init.lua": b"f()\n",
        ".hidden.lua": b"g()\n", "b/c/notes.txt": b"no source", "b/sp ace é.lua": b"h()\n", "b/x.lua.part": b"half",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / "b" / "loop").symlink_to(root)
    (root / "nothing").mkdir()
    return root


def test_all_source_files_of_all_levels(spark, root):
    got = {r["path"].removeprefix(f"{root}/"): r["size"] for r in tree.list_tree(spark, str(root)).collect()}
    assert got == {"a.lua": 12, "b/c/d/e.luau": 9, "b/bad.luau": 1, "b/empty.lua": 0, "_under/_init.lua": 4, ".hidden.lua": 4, "b/sp ace é.lua": 4}
    uri = tree.list_tree(spark, f"file://{root}").count()
    assert uri == len(got)


def test_units(spark, root):
    rows = {r["location"].rsplit("/", 1)[-1]: r for r in tree.read_tree(spark, str(root)).collect()}
    assert rows["e.luau"]["content"] == "return 1\n" and rows["empty.lua"]["content"] == ""
    assert (rows["bad.luau"]["valid_utf8"], rows["bad.luau"]["content"]) == (False, None)
    plain = files.read_source_tree(spark, str(root / "b" / "c")).collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in tree.read_tree(spark, str(root / "b" / "c")).collect()]


def test_no_files(spark, root):
    with pytest.raises(ValueError, match="no .luau/.lua files"):
        tree.read_tree(spark, str(root / "nothing"))
    with pytest.raises(Exception, match="missing"):
        tree.read_tree(spark, str(root / "missing"))


def test_written_files_come_back(spark, tmp_path, monkeypatch):
    texts = {f"f{i % 7}/g{i % 3}/{i}.lua": "é" * i for i in range(300)} | {"top.lua": None}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    for _ in range(2):
        assert tree.write_tree(rows, str(tmp_path)).count() == len(texts)
    back = {r["location"].removeprefix(f"{tmp_path}/"): r["content"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    assert not list(tmp_path.rglob("*.part"))


def test_ordinals_are_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"))
    got = with_ordinal(rows, "k", "n", parts=7).orderBy("ordinal").collect()
    want = sorted(((r["n"], r["k"]) for r in rows.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r["n"], r["k"]) for r in got] == want
    assert [r["ordinal"] for r in got] == list(range(1000))
    same = with_ordinal(spark.range(50).select(F.lit(1).alias("n")), "n", parts=4)
    assert sorted(r["ordinal"] for r in same.collect()) == list(range(50))
    assert with_ordinal(rows.limit(0), "n").isEmpty()
    with pytest.raises(ValueError, match="already"):
        with_ordinal(rows, "n", name="k")


def test_reports_are_written_in_input_order(spark, units_of, tmp_path):
    names = [f"u{i * 37 % 100}" for i in range(100)]
    units = units_of({n: "wait(1)\nlocal x = (\n" for n in names})
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("unit_id"))
    units = with_ordinal(units.withColumn("place", place), "place")
    a = Analysis(units)
    for at, report in enumerate((outcomes.job_report(units), reports.report_json(reports.file_report(a.units, a.findings)))):
        path = tmp_path / str(at)
        files.write_report(report, str(path), order_by=["ordinal"], parts=4)
        lines = [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text("utf-8").splitlines()]
        assert [x["source_location"] for x in lines] == names

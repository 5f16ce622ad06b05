"""Work that must not be done twice, and the partitions it is dealt to."""

import uuid

from pyspark.sql import functions as F

from lumenscan.operators import headers
from lumenscan.operators.outline import functions, located
from lumenscan.plans import outcomes
from lumenscan.sources.files import write_report

TEXTS = {f"u{i}": f'local a = (1 + {i})\nfunction f{i}(x)\n\tif x then\n\t\tg("open\n\tend\n' for i in range(9)}


def test_statistics_take_the_partitions_of_the_text(units_of):
    units = units_of(TEXTS)
    sized = outcomes.parse_statistics(units, 7)
    dealt = sized._jdf.queryExecution().executedPlan().toString().count("7), REPARTITION_BY_NUM")
    assert dealt == 2  # tokens and elements
    assert sorted(map(tuple, sized.collect())) == sorted(map(tuple, outcomes.parse_statistics(units).collect()))


def test_an_ordered_report_is_derived_once(spark, tmp_path):
    """The cuts of the ranges are drawn from the stored report, not from a second run of what derives it."""
    seen = str(tmp_path / "seen")

    def derive(batches):
        from pathlib import Path

        for batch in batches:
            Path(f"{seen}-{uuid.uuid4().hex}").write_text(str(batch.num_rows))
            yield batch

    rows = spark.range(100, numPartitions=3).mapInArrow(derive, "id bigint")
    write_report(rows, str(tmp_path / "report"), order_by=["id"], parts=2)
    assert sum(int(f.read_text()) for f in tmp_path.glob("seen-*")) == 100
    assert [r.id for r in spark.read.json(str(tmp_path / "report")).sort("id").collect()] == list(range(100))


def test_open_headers_of_a_file_are_looked_up_once(spark):
    """The pattern stands once in the expression: not again for each header that uses the places found."""
    lexemes = spark.createDataFrame([], "lexemes array<struct<raw: string, text: string>>")
    plan = lexemes.select(headers.assembled(F.col("lexemes")).alias("lexemes"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(headers._OPEN) == 1


def test_many_open_headers_in_one_file(units_of):
    text = "".join(f"function f{i}<T>(x: ((((T))))): T return x end\n" for i in range(60))
    assert [r.fn_name for r in functions(units_of({"a": text})).sort("fn_no").collect()] == [f"f{i}" for i in range(60)]


def test_the_text_of_a_header_is_bared_once(spark):
    """The depth behind a lexeme is read by many branches of the search; it is derived once, in one place."""
    lexemes = spark.createDataFrame([], "lexemes array<struct<raw: string, text: string>>")
    plan = lexemes.select(headers.assembled(F.col("lexemes")).alias("lexemes"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(headers._QUOTED) == 1


def test_passes_hand_wide_columns_on_as_one(units_of):
    """Columns that passes do not read are one struct in them, and come back as they were."""
    text = "function f(x)\n\tif a then\n\t\tb()\n\tend\nend\n"
    rows = located(units_of({"a": text}))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS _others#") == 2  # block depths, and places
    assert "".join(r["raw"] for r in rows.filter("ev = 0").orderBy("n").collect()) == text

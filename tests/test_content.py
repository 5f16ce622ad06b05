"""Results kept by content: equal to the direct ones, and derived once."""

import pytest
from pyspark.sql import functions as F

from lumenscan.plans.content import ContentStore
from lumenscan.plans.outcomes import STATISTICS, outcomes, parse_statistics

A = "function M.a(x)\n  if x then\n    print(x)\n  end\nend\n"
B = "function M.b()\n  while true do\n  end\nend\nlocal y = 'open\n"


def lines(units):
    return units.select("unit_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def counted(store, derived):
    """``lines`` that notes the texts it is given."""

    def derive(units):
        rows = units.select("unit_id").collect()
        derived.extend(r["unit_id"] for r in rows)
        return lines(units)

    return derive


def table(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def units(units_of):
    return units_of({"a": A, "b": B, "empty": "", **{f"copy{i}": A for i in range(9)}, "none": None})


@pytest.mark.parametrize("copies_per_task", [100_000, 4, 1])
def test_rows_are_the_direct_ones(spark, units, tmp_path, copies_per_task):
    """Copies are served by one task or by several; a file without a text gives nothing."""
    store = ContentStore(spark, str(tmp_path), copies_per_task=copies_per_task)
    assert table(store.rows(units, "lines", lines)) == table(lines(units))


def test_a_text_is_derived_once(spark, units, units_of, tmp_path):
    store, derived = ContentStore(spark, str(tmp_path)), []
    derive = counted(store, derived)
    store.update(units, "lines", derive)
    assert len(derived) == len(set(derived)) == 3
    store.update(units, "lines", derive)
    assert len(derived) == 3
    more = units.unionByName(units_of({"new": A + B, "again": B}))
    assert table(store.rows(more, "lines", derive)) == table(lines(more))
    assert len(set(derived)) == 4
    other = ContentStore(spark, str(tmp_path), version="other")
    assert other.keys("lines").count() == 0 and store.keys("lines").count() == 4


def test_an_empty_job_and_lost_runs(spark, units, tmp_path):
    store = ContentStore(spark, str(tmp_path))
    assert store.rows(units.limit(0), "lines", lines).count() == 0
    want = table(lines(units))
    texts = units.withColumn("unit_id", F.sha2("content", 256)).filter("content is not null").dropDuplicates(["unit_id"])
    kept = lines(texts).withColumnRenamed("unit_id", "content_sha2")
    # Rows without keys, as of a run lost in between, and a second run over the same texts.
    store._append(kept, "lines", "rows", "lost")
    assert table(store.rows(units, "lines", lines)) == want
    store._append(kept, "lines", "rows", "second")
    store._append(texts.select(F.col("unit_id").alias("content_sha2")), "lines", "keys", "second")
    assert table(store.rows(units, "lines", lines)) == want


def test_outcomes_from_kept_counts(spark, units, tmp_path):
    bad = spark.createDataFrame([("bad", "bad", None, None, False)], units.schema)
    units = units.filter("content is not null").unionByName(bad)
    kept = ContentStore(spark, str(tmp_path)).rows(units, "statistics", lambda u: parse_statistics(u).select("unit_id", *STATISTICS))
    assert table(outcomes(units, kept)) == table(outcomes(units))

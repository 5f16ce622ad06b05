"""Parse outcomes per file and the job report over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan import LEXER_VERSION
from lumenscan.operators.diagnostics import problems
from lumenscan.operators.elements import elements
from lumenscan.operators.lexing import tokens

SUCCEEDED = "succeeded"
WITH_DIAGNOSTICS = "succeeded_with_diagnostics"
FAILED = "technical_failure"
REPORT_VERSION = "1.0.0"


def _unreadable(message_of: str) -> Column:
    return F.concat(F.lit("source file is not valid UTF-8 "), message_of)


def _token_side(units: DataFrame, nested: bool, partitions: int | None) -> DataFrame:
    """unit_id, token_count and diagnostic_count of readable files with tokens, from one pass over the tokens."""
    out = [
        F.coalesce(F.max("count"), F.lit(0)).cast("bigint").alias("token_count"),
        F.count("message").alias("diagnostic_count"),
    ]
    if nested:
        out.append(_ordered("diagnostics", ["line", "col"], DIAGNOSTIC_FIELDS, F.col("message").isNotNull()))
    return problems(tokens(units, partitions)).groupBy("unit_id").agg(*out)


def _per_unit(units: DataFrame, nested: bool, with_elements: bool = True, partitions: int | None = None) -> DataFrame:
    """Units with the counts of their parts, and with the parts themselves if ``nested``.

    Tokens and elements come hash-partitioned on ``unit_id``, ready for the joins, and each is
    derived once.  An unreadable file has no tokens and one diagnostic, at 0:0.  ``partitions`` are those
    of the text (``lexing.text_partitions``), the session's by default.
    """
    bad = ~F.col("valid_utf8")
    rows = units.select("unit_id", "location", "valid_utf8").join(_token_side(units, nested, partitions), "unit_id", "left")
    rows = rows.fillna(0, ["token_count", "diagnostic_count"])
    rows = rows.withColumn("diagnostic_count", F.when(bad, F.lit(1)).otherwise(F.col("diagnostic_count")).cast("bigint"))
    if nested:
        alone = F.struct(F.lit("error").alias("severity"), _unreadable("location").alias("message"), F.lit(0).alias("line"), F.lit(0).alias("col"))
        alone = F.array(alone).cast(dict(rows.dtypes)["diagnostics"])
        rows = rows.withColumn("diagnostics", F.when(bad, alone).otherwise(F.col("diagnostics")))
    if not with_elements:
        return rows
    in_elements = [F.count("*").alias("element_count")]
    if nested:
        in_elements.append(_ordered("structural_elements", ["elem_no"], ELEMENT_FIELDS))
    rows = rows.join(elements(units, partitions).groupBy("unit_id").agg(*in_elements), "unit_id", "left")
    return rows.fillna(0, ["element_count"])


ELEMENT_FIELDS = ("kind", "name", "line", "col", "container", "signature")
DIAGNOSTIC_FIELDS = ("severity", "message", "line", "col")


def _ordered(name: str, by: list[str], fields: tuple[str, ...], where: Column | None = None) -> Column:
    """An array of structs of ``fields``, in the order of ``by``."""
    rest = [f for f in fields if f not in by]
    one = F.struct(*by, *rest)
    rows = F.array_sort(F.collect_list(one if where is None else F.when(where, one)))
    return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)


def parse_statistics(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Token, element and diagnostic counts per file."""
    return _per_unit(units, nested=False, partitions=partitions)


def _status() -> Column:
    with_diagnostics = F.when(F.col("diagnostic_count") > 0, WITH_DIAGNOSTICS)
    return F.when(~F.col("valid_utf8"), FAILED).otherwise(with_diagnostics.otherwise(SUCCEEDED))


def _failure() -> Column:
    return F.when(~F.col("valid_utf8"), _unreadable("location"))


STATISTICS = ("token_count", "element_count", "diagnostic_count")


def _with_statistics(units: DataFrame, statistics: DataFrame) -> DataFrame:
    """``parse_statistics`` of ``units`` from counts of their readable files; files without any have zeros."""
    rows = units.select("unit_id", "location", "valid_utf8").join(statistics.select("unit_id", *STATISTICS), "unit_id", "left")
    rows = rows.fillna(0, list(STATISTICS))
    alone = F.when(~F.col("valid_utf8"), F.lit(1)).otherwise(F.col("diagnostic_count"))
    return rows.withColumn("diagnostic_count", alone.cast("bigint"))


def outcomes(units: DataFrame, statistics: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """One outcome per file; an unreadable file fails alone.

    ``statistics`` are counts known already, as those a ``ContentStore`` keeps.
    """
    rows = parse_statistics(units, partitions) if statistics is None else _with_statistics(units, statistics)
    return rows.select(
        "unit_id",
        "location",
        F.lit(LEXER_VERSION).alias("lexer_version"),
        _status().alias("status"),
        "token_count",
        "element_count",
        "diagnostic_count",
        _failure().alias("failure_message"),
    )


def statuses(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """unit_id and status alone, for which no elements are derived."""
    return _per_unit(units, nested=False, with_elements=False, partitions=partitions).select("unit_id", _status().alias("status"))


def job_summary(outcome_rows: DataFrame) -> DataFrame:
    status = F.col("status")
    return outcome_rows.agg(
        F.count("*").alias("source_count"),
        F.count_if(status == SUCCEEDED).alias("succeeded_count"),
        F.count_if(status == WITH_DIAGNOSTICS).alias("succeeded_with_diagnostics_count"),
        F.count_if(status == FAILED).alias("technical_failure_count"),
    )


def job_invariants(units: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """Violations of: at least one unit, unique ids, and one outcome for each unit.

    The counts per id pre-aggregate before they shuffle, so many copies of one id are cheap.
    """
    tagged = units.select("unit_id", F.lit(1).alias("u"), F.lit(0).alias("o")).unionByName(
        outcome_rows.select("unit_id", F.lit(0).alias("u"), F.lit(1).alias("o"))
    )
    counts = tagged.groupBy("unit_id").agg(F.sum("u").alias("u"), F.sum("o").alias("o"))
    problem = F.filter(
        F.array(
            F.when(F.col("u") > 1, "duplicate unit"),
            F.when((F.col("u") == 0), "unknown unit"),
            F.when((F.col("o") == 0), "missing outcome"),
        ),
        lambda p: p.isNotNull(),
    )
    found = counts.select("unit_id", F.explode(problem).alias("violation"))
    empty = (
        units.agg(F.count("*").alias("n"))
        .filter("n = 0")
        .select(F.lit(None).cast("string").alias("unit_id"), F.lit("empty job").alias("violation"))
    )
    return found.unionByName(empty)


def job_report(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nested report per file; the order of files is set where it is written.

    Units with an ``ordinal`` (``plans.ordinals``) give it to their reports, which are in the order of
    the input when they are written by it.
    """
    rows = _per_unit(units, nested=True, partitions=partitions)
    place = []
    if "ordinal" in units.columns:
        rows, place = rows.join(units.select("unit_id", "ordinal"), "unit_id", "left"), ["ordinal"]
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c)
    return rows.select(
        *place,
        F.lit(REPORT_VERSION).alias("schema_version"),
        F.col("location").alias("source_location"),
        F.lit(LEXER_VERSION).alias("grammar_version"),
        _status().alias("status"),
        empty("diagnostics"),
        empty("structural_elements"),
        F.struct(
            "token_count",
            F.col("element_count").alias("structural_element_count"),
            "diagnostic_count",
        ).alias("statistics"),
        _failure().alias("failure_message"),
    )

"""Reports over findings and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "info")


def _by_severity(prefix: str = "") -> list:
    return [F.count_if(F.col("severity") == s).alias(prefix + s) for s in SEVERITIES]


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(*_by_severity())


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_no", "rule").agg(F.count("*").alias("n_findings"))


def file_counts(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding counts per file; clean files keep zeros."""
    counts = findings.groupBy("unit_id").agg(F.count("*").alias("smell_count"), *_by_severity())
    names = ["smell_count", *SEVERITIES]
    return units.select("unit_id", "location").join(counts, "unit_id", "left").fillna(0, names)


def file_report(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file: counts and the findings in order of function, rule and step.

    ``line`` is filled here; ``report_json`` gives the shape that leaves it null.
    """
    order = F.struct("fn_no", "rule_no", F.coalesce("step_no", F.lit(-1)).alias("at"), "rule", "severity", "message",
                     F.col("fn_name").alias("function"), "line")
    fields = ("rule", "severity", "message", "function", "line")
    smells = F.transform(F.array_sort(F.collect_list(order)), lambda s: F.struct(*[s[c].alias(c) for c in fields]))
    grouped = findings.groupBy("unit_id").agg(
        F.count("*").alias("smell_count"), *_by_severity(), smells.alias("smells")
    )
    place = ["ordinal"] if "ordinal" in units.columns else []
    rows = units.select("unit_id", "location", *place).join(grouped, "unit_id", "left")
    rows = rows.fillna(0, ["smell_count", *SEVERITIES])
    none = F.array().cast(dict(rows.dtypes)["smells"])
    return rows.withColumn("smells", F.coalesce("smells", none))


def report_json(file_reports: DataFrame) -> DataFrame:
    """File reports in the nested output shape, with ``line`` null; an ``ordinal`` stays in front."""
    smells = F.transform("smells", lambda s: s.withField("line", F.lit(None).cast("int")))
    return file_reports.select(
        *(["ordinal"] if "ordinal" in file_reports.columns else []),
        F.col("location").alias("source_location"),
        "smell_count",
        F.struct(*SEVERITIES).alias("summary"),
        smells.alias("smells"),
    )


def corpus_report(units: DataFrame, findings: DataFrame) -> DataFrame:
    """File count, finding count and severities of the corpus, in one row."""
    marks = units.select(F.lit(1).alias("file"), F.lit(None).cast("string").alias("severity")).unionByName(
        findings.select(F.lit(0).alias("file"), "severity")
    )
    return marks.agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("file_count"),
        F.count("severity").alias("total_smells"),
        *_by_severity(),
    )


def function_index(units: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: function count, names in order, and the name of its output page."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("fn_no", "fn_name"))), lambda f: f["fn_name"])
    grouped = functions.groupBy("unit_id").agg(F.count("*").alias("function_count"), names.alias("function_names"))
    page = F.regexp_replace("location", r"\.(?:luau|lua)$", ".nassi.html")
    rows = units.select("unit_id", "location").join(grouped, "unit_id", "left").fillna(0, ["function_count"])
    return rows.select(
        "unit_id",
        "location",
        "function_count",
        F.coalesce("function_names", F.array().cast("array<string>")).alias("function_names"),
        page.alias("output_name"),
    )

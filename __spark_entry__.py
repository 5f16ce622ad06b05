
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions.labels import compact_label
from lumenscan.operators import blocks, context, diagnostics, elements, lexing, ownership, pieces, rules, sequences
from lumenscan.operators.outline import STEP_COLUMNS, outline, steps_of
from lumenscan.plans import outcomes, reports
from lumenscan.plans.analysis import Analysis
from lumenscan.plans.content import ContentStore
from lumenscan.plans.ordinals import with_ordinal
from lumenscan.session import work_dir
from lumenscan.sources.corpus import script_corpus
from lumenscan.sources.files import decode_source, read_steps, write_report
from lumenscan.sources.tree import read_tree, write_tree
from lumenscan.verification.oracle import oracle

try:
    from lumenscan.llm import queries as llm
except ImportError as error:
    if error.name not in ("lumenscan.llm", "corpus_pipeline"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]
_ANALYSES: dict[tuple[str, str], Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of the corpus derived from ``sf_dir``, shared by this session's queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ANALYSES:
        _ANALYSES[key] = Analysis(script_corpus(spark, sf_dir))
    return _ANALYSES[key]


def entry(spark: SparkSession) -> DataFrame:
    """Finding counts per file of the derived corpus."""
    a = analysis(spark, "/root/testdata/sf0.001")
    return reports.file_counts(a.units, a.findings)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(stage: str, fn: Callable[..., DataFrame]) -> Query:
    """A query over stages of the analysis, named by a comma-separated list."""
    return lambda spark, sf_dir: fn(*[getattr(analysis(spark, sf_dir), s) for s in stage.split(",")])


def _sized(fn: Callable[..., DataFrame]) -> Query:
    """A query over the stored units, in as many partitions as their text needs."""
    return _on("units", lambda units: fn(units, partitions=lexing.text_partitions(units)))


def _tokens(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _sized(lambda units, partitions: fn(lexing.tokens(units, partitions)))


def _pick(stage: str, *columns, where: str | None = None) -> Query:
    def run(df: DataFrame) -> DataFrame:
        df = df.filter(where) if where else df
        return df.select(*columns)

    return _on(stage, run)


def _compact(steps: DataFrame) -> DataFrame:
    text = F.coalesce("label", "condition", "header")
    return steps.select(
        "unit_id", "fn_no", "step_no", compact_label(text, 60).alias("shown"), compact_label(text, 96).alias("shown_96")
    )


def _file_report(units: DataFrame, findings: DataFrame) -> DataFrame:
    """The report with its nested findings flattened to one string."""
    report = reports.file_report(units, findings.withColumn("rule", F.concat("rule", F.lit(":"), F.coalesce("step_no", F.lit(-1)))))
    return report.withColumn("smells", F.array_join(F.transform("smells", lambda s: s["rule"]), ","))


def _written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, written and read back."""
    a = analysis(spark, sf_dir)
    report = reports.report_json(reports.file_report(a.units, a.findings))
    path = f"{work_dir(spark).rstrip('/')}/report-{spark.sparkContext.applicationId}-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    write_report(report, path, mode="overwrite", order_by=["source_location"])
    back = spark.read.schema(report.schema).json(path)
    return back.select("source_location", "smell_count", "summary.*")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ordered_job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job report in the order of the input (customer and shard), written and read back in the order of its lines."""
    units = analysis(spark, sf_dir).units
    customer = F.regexp_extract("unit_id", r"c(\d+)", 1).cast("bigint")
    placed = with_ordinal(units.withColumn("customer", customer), "customer", "unit_id")
    report = outcomes.job_report(placed, lexing.text_partitions(units))
    path = _scratch(spark, "job-report")
    write_report(report, path, order_by=["ordinal"])
    back = spark.read.schema(report.schema).json(path)
    back = back.select("*", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = with_ordinal(back, "file_name", "file_block_start", "row", name="line_no")
    return lines.select("ordinal", "line_no", "source_location", "status", "statistics.token_count")


def _tree_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files in two levels of folders, then listed and read by executors."""
    doc = F.col("doc_id").cast("string")
    name = F.concat(F.lit("d"), F.col("doc_id") % 20, F.lit("/e"), F.col("doc_id") % 3, F.lit("/"), doc)
    suffix = F.when(F.col("doc_id") % 2 == 0, ".lua").otherwise(".luau")
    root = _scratch(spark, "tree")
    write_tree(_table(spark, sf_dir, "documents").select(F.concat(name, suffix).alias("path"), F.col("text").alias("content")), root)
    units = read_tree(spark, root)
    place = F.substring_index("location", "/", -3)
    return units.select(place.alias("place"), "valid_utf8", F.length("content").cast("bigint").alias("n_chars"), "content_sha2")


def _function_index(units: DataFrame, functions: DataFrame) -> DataFrame:
    return reports.function_index(units, functions).withColumn("function_names", F.array_join("function_names", ","))


def _job_report(units: DataFrame, partitions: int) -> DataFrame:
    named = F.transform("structural_elements", lambda e: F.concat(e["kind"], F.lit(" "), e["name"]))
    messages = F.transform("diagnostics", lambda d: d["message"])
    return outcomes.job_report(units, partitions).select(
        "source_location",
        "status",
        "statistics.token_count",
        F.array_join(named, ",").alias("element_list"),
        F.array_join(messages, ",").alias("messages"),
    )


def _elements_of(*args, partitions: int) -> DataFrame:
    *kinds, units = args
    return elements.elements_of_kind(units, *kinds, partitions=partitions)


def _job_invariants(units: DataFrame) -> DataFrame:
    """Units and outcomes with known defects: copies, missing outcomes, unknown units."""
    number = F.regexp_extract("unit_id", r"c(\d+)", 1).cast("int")
    ids = units.select("unit_id", number.alias("c"))
    twice = ids.unionByName(ids.filter("c % 11 = 0"))
    unknown = ids.filter("c % 10 = 0").withColumn("unit_id", F.concat("unit_id", F.lit(".gone")))
    return outcomes.job_invariants(twice, ids.filter("c % 13 <> 0").unionByName(unknown))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes, every seventh one broken."""
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    content = F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.encode("text", "UTF-8"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").select(name.alias("unit_id"), name.alias("location"), content.alias("content"))
    sha = F.when(F.col("valid_utf8"), F.col("content_sha2")).alias("sha2")
    return decode_source(rows).select("unit_id", "valid_utf8", F.length("content").cast("bigint").alias("n_chars"), sha)


def _events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_table(spark, sf_dir, "events"))


def _after(first_only: bool) -> Query:
    ends = lambda: F.col("event_type") == "error"
    return _events(
        lambda e: sequences.after_terminator(e, ["user_id"], ["ts", "event_id"], ends(), first_only, F.to_date("ts")).select(
            "event_id", "user_id", "event_type"
        )
    )


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.page_tags(_table(spark, sf_dir, "pages"))


def _inside_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each page with the number of articles around them."""
    tags = _tags(spark, sf_dir)
    marks = sequences.level_pairs(tags.filter("tag = 'article'"), ["page_id"], "pos", "delta")
    found = sequences.inside_block(tags, marks, ["page_id"])
    return found.select("page_id", "pos", "tag", "n_blocks")


def _view_spans(events: DataFrame) -> DataFrame:
    """Views of a user paired with the clicks that close them, over buckets of events."""
    change = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1)
    marks = events.select("user_id", "event_id", change.alias("delta")).filter("delta is not null")
    return sequences.level_pairs(marks, ["user_id"], "event_id", "delta", F.floor(F.col("event_id") / 500))


def _url_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text is as long as that of the page before them by address, per last digit of that length."""
    pages = _table(spark, sf_dir, "pages").select(
        (F.length("html") % 10).alias("digit"), "url", "page_id", (F.length("html") % 100).alias("size")
    )
    return sequences.adjacent_duplicates(pages, ["digit"], ["url", "page_id"], "size", sequences.data_buckets(pages, ["url", "page_id"]))


def _own_rules() -> list[rules.Rule]:
    """Two rules of a caller: calls inside an ``if`` or a loop, and functions of 20 steps or more."""
    inside = F.col("in_loop") | (F.col("if_depth") > 0)
    return [
        rules.Rule(101, "nested-call", "info", (F.col("kind") == "action") & inside & F.col("label").contains("("), "'{label}' {if_depth} deep in '{f}'"),
        rules.Rule(102, "twenty-steps", "warning", F.col("n_steps") >= 20, "'{f}' has {n_steps} steps", whole_function=True),
    ]


def _own_findings(steps: DataFrame, functions: DataFrame) -> DataFrame:
    return rules.findings(steps, functions, rules=("nested-call", "twenty-steps"), extra=_own_rules())


def _own_rule_counts(steps: DataFrame, functions: DataFrame) -> DataFrame:
    """All thirty rules and two more in one pass, counted."""
    return reports.rule_counts(rules.findings(steps, functions, extra=_own_rules()))


def _kept(spark: SparkSession, sf_dir: str, kind: str, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The corpus with two copies of each file, and results kept by content from a run over the plain corpus."""
    units = analysis(spark, sf_dir).units
    name = f"contents-{spark.sparkContext.applicationId}-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    store = ContentStore(spark, f"{work_dir(spark).rstrip('/')}/{name}")
    store.update(units, kind, derive)
    copies = units.withColumn("copy", F.explode(F.array(F.lit(""), F.lit("#1"), F.lit("#2"))))
    copies = copies.withColumn("unit_id", F.concat("unit_id", "copy")).drop("copy")
    return copies, store.rows(copies, kind, derive)


def _statistics(units: DataFrame) -> DataFrame:
    return outcomes.parse_statistics(units).select("unit_id", *outcomes.STATISTICS)


def _outcomes_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcomes(*_kept(spark, sf_dir, "statistics", _statistics))


def _steps_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "steps", lambda u: steps_of(outline(u)).select(*STEP_COLUMNS))[1]


def _typed(units: DataFrame) -> DataFrame:
    """Steps of the corpus with a return type on every multi-line function."""
    header = r"(function [A-Za-z0-9_.]+)\(x\)\n"
    typed = F.regexp_replace("content", header, "$1(x: number): (number, string?)\n")
    return steps_of(outline(units.withColumn("content", typed)))


def _step_kinds(where: str) -> Query:
    return _pick("steps", *STEP_COLUMNS, where=where)


def _around_do_blocks(steps: DataFrame) -> DataFrame:
    """Every step of the functions that hold a ``do`` block."""
    holders = steps.filter("label = 'use(q)'").select("unit_id", "fn_no").distinct()
    return steps.join(holders, ["unit_id", "fn_no"], "left_semi").select(*STEP_COLUMNS)


def _lexed(name: str, key: str, text: str) -> Query:
    """What the lossless lexer makes of foreign text: the lexemes must give the text again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = _table(spark, sf_dir, name).select(F.col(key).cast("string").alias("unit_id"), F.col(text).alias("content"))
        return lexing.lossless(units).select(
            "unit_id", "same", "n_chars", F.sha2("joined", 256).alias("sha2"), F.col("n_lexemes") > 0
        ).toDF("unit_id", "same", "n_chars", "sha2", "has_lexemes")

    return run


def queries() -> dict[str, Query]:
    steps, both = "steps", "steps,functions"
    out: dict[str, Query] = {
        "corpus": _pick("units", "unit_id", "content"),
        "decode_source": _decoded,
        "read_steps": _on(steps, lambda s: read_steps(s.drop("sub_end")).select("unit_id", "fn_no", "step_no", "sub_end")),
        "read_tree": _tree_of_documents,
        "write_report": _written_report,
        "job_report_ordered": _ordered_job_report,
        "tokens": _sized(lexing.tokens),
        "tokens_pieces": _on("units", lambda u: pieces.tokens(u, 1024)),
        "lossless_documents": _lexed("documents", "doc_id", "text"),
        "lossless_pages": _lexed("pages", "page_id", "html"),
        "token_classes": _on("units", lexing.token_classes),
        "token_classes_pieces": _on("units", lambda u: pieces.token_classes(u, 1024)),
        "block_depth": _tokens(blocks.block_depth),
        "block_pairs": _tokens(blocks.block_pairs),
        "functions": _pick("functions", "unit_id", "fn_no", "fn_name", "container", "signature", "line"),
        "function_name": _pick("functions", "unit_id", "fn_no", "fn_name"),
        "function_container": _pick("functions", "unit_id", "fn_no", "container"),
        "function_signature": _pick("functions", "unit_id", "fn_no", "signature"),
        "skip_return_type": _on("units", _typed),
        "statements": _on(steps, lambda s: s.select("unit_id", "fn_no", F.col("step_no").alias("stmt_no"), "line")),
        "compact_label": _on(steps, _compact),
        "steps": _pick(steps, *STEP_COLUMNS),
        "steps_if_chain": _step_kinds("kind = 'if'"),
        "steps_while": _step_kinds("kind = 'while'"),
        "steps_for": _step_kinds("kind in ('for_in', 'numeric_for')"),
        "steps_repeat": _step_kinds("kind = 'repeat_until'"),
        "steps_do_splice": _on(steps, _around_do_blocks),
        "steps_closure": _step_kinds("kind = 'closure'"),
        "elements": _sized(elements.elements),
        "elements_function": _sized(partial(_elements_of, "function")),
        "elements_local_function": _sized(partial(_elements_of, "local_function")),
        "elements_local": _sized(partial(_elements_of, "constant", "variable")),
        "elements_type_alias": _sized(partial(_elements_of, "type_alias")),
        "element_container": _sized(
            lambda u, partitions: elements.elements(u, partitions).groupBy("container").agg(F.count("*").alias("n"))
        ),
        "diagnostics": _tokens(diagnostics.diagnostics),
        "ownership": _on("units", ownership.ownership_counts),
        "parse_statistics": _sized(
            lambda u, partitions: outcomes.parse_statistics(u, partitions).select("unit_id", "token_count", "element_count", "diagnostic_count")
        ),
        "outcomes": _sized(outcomes.outcomes),
        "outcomes_by_content": _outcomes_by_content,
        "steps_by_content": _steps_by_content,
        "job_summary": _sized(lambda u, partitions: outcomes.job_summary(outcomes.statuses(u, partitions))),
        "job_invariants": _on("units", _job_invariants),
        "job_report": _sized(_job_report),
        "step_context": _on(steps, context.step_context),
        "total_steps": _on(steps, context.total_steps),
        "max_depth": _on(steps, context.max_depth),
        "corpus_max_depth": _on(steps, context.corpus_max_depth),
        "function_labels": _on(steps, context.function_labels),
        "exits": _on(steps, context.exits),
        "type_checks": _on(steps, context.type_checks),
        "terminators": _on(steps, context.terminators),
        "findings": _on(both, rules.findings),
        "findings_own": _on(both, _own_findings),
        "rule_counts_own": _on(both, _own_rule_counts),
        "severity_summary": _on("findings", reports.severity_summary),
        "rule_counts": _on("findings", reports.rule_counts),
        "file_report": _on("units,findings", _file_report),
        "corpus_report": _on("units,findings", reports.corpus_report),
        "function_index": _on("units,functions", _function_index),
        "adjacent_duplicates": lambda spark, d: sequences.adjacent_duplicates(
            sequences.document_lines(_table(spark, d, "documents")), ["doc_id"], ["line_no"], "line"
        ),
        "adjacent_duplicates_turns": lambda spark, d: sequences.adjacent_duplicates(
            _table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role"
        ),
        "adjacent_duplicates_initials": lambda spark, d: sequences.adjacent_duplicates(
            _table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.substring("text", 1, 1)).alias("initial")),
            ["conv_id"], ["turn"], "initial",
        ),
        "adjacent_duplicates_events": _events(
            lambda e: sequences.adjacent_duplicates(
                e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts")
            ).drop("ts")
        ),
        "after_terminator": _after(True),
        "after_terminator_all": _after(False),
        "nesting_depth": lambda spark, d: sequences.nesting_depth(_tags(spark, d), ["page_id"], ["pos"], F.col("delta")),
        "inside_block": _inside_article,
        "level_pairs_events": _events(_view_spans),
        "adjacent_duplicates_urls": _url_neighbours,
        "group_missing_partner": _events(
            lambda e: sequences.group_missing_partner(
                e, ["user_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase"
            )
        ),
        "group_missing_partner_daily": _events(
            lambda e: sequences.group_missing_partner(
                e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")),
                ["user_id", "day"],
                F.col("event_type") == "signup",
                F.col("event_type") == "purchase",
            )
        ),
        "bucketed_rule_summary": _events(
            lambda e: sequences.bucketed_rule_summary(
                e, ["user_id"], "event_type", ["signup", "purchase", "error", "view", "click"]
            )
        ),
    }
    for name in rules.RULE_NAMES:
        out[f"findings_{name}"] = _on(both, partial(rules.findings, rules=(name,)))
    return out | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracle() | (llm.SQL if llm else {})

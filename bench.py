"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stages are timed one after the other, each from its written input: nothing is cached, and
Spark's start and one pass over the smallest data (code generation) are left out.
"""

from __future__ import annotations

import json
import os
import pathlib
import re
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lumenscan.operators import blocks, context, elements, lexing, sequences  # noqa: E402
from lumenscan.operators.outline import functions_of, outline, steps_of  # noqa: E402
from lumenscan.operators.rules import findings  # noqa: E402
from lumenscan.plans import outcomes, reports  # noqa: E402
from lumenscan.session import build_session, write_stage  # noqa: E402
from lumenscan.sources.corpus import script_corpus  # noqa: E402


def measure(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], dict[str, int]]:
    seconds: dict[str, float] = {}

    def staged(name: str, build) -> DataFrame:
        started = time.perf_counter()
        out = write_stage(build(), name)
        seconds[name] = round(time.perf_counter() - started, 3)
        return out

    def run(name: str, build) -> None:
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)

    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    units = staged("corpus", lambda: script_corpus(spark, sf_dir))
    run("tokens", lambda: lexing.tokens(units))
    run("token_classes", lambda: lexing.token_classes(units))
    run("block_depth", lambda: blocks.block_depth(lexing.tokens(units)))
    outlined = staged("steps", lambda: outline(units))
    steps, functions = steps_of(outlined), functions_of(outlined)
    run("step_context", lambda: context.step_context(steps))
    found = staged("findings", lambda: findings(steps, functions))
    run("file_report", lambda: reports.file_report(units, found))
    run("corpus_report", lambda: reports.corpus_report(units, found))
    run("elements", lambda: elements.elements(units))
    run("outcomes", lambda: outcomes.outcomes(units))
    lines = lambda: sequences.document_lines(table("documents"))
    run("adjacent_duplicates", lambda: sequences.adjacent_duplicates(lines(), ["doc_id"], ["line_no"], "line"))
    run(
        "after_terminator",
        lambda: sequences.after_terminator(
            table("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", bucket=F.to_date("ts")
        ),
    )
    run(
        "nesting_depth",
        lambda: sequences.nesting_depth(sequences.page_tags(table("pages")), ["page_id"], ["pos"], F.col("delta")),
    )
    n_tokens = F.size(F.regexp_extract_all("content", F.lit(lexing.lx.TOKEN_LEX), F.lit(0)))
    counts = units.agg(F.count("*").alias("units"), F.sum(n_tokens).alias("tokens")).first().asDict()
    counts["steps"] = steps.count()
    counts["findings"] = found.count()
    return seconds, counts


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = build_session(
        app="lumenscan-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = pathlib.Path(sf_dir).parent / "sf0.001"
    if warm.is_dir():
        measure(spark, str(warm))
    seconds, counts = measure(spark, sf_dir)
    pipeline = round(sum(seconds[q] for q in ("corpus", "steps", "findings", "corpus_report")), 3)
    rate = lambda n, *qs: round(n / sum(seconds[q] for q in qs), 1)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "corpus to report (corpus + steps + findings + corpus_report)",
        "value": pipeline,
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else sf_dir,
        "counts": counts,
        "rates": {
            "tokens_per_s": rate(counts["tokens"], "tokens"),
            "units_per_s_steps": rate(counts["units"], "steps"),
            "tokens_per_s_steps": rate(counts["tokens"], "steps"),
            "steps_per_s_findings": rate(counts["steps"], "findings"),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()

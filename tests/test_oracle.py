"""Registered queries against their SQL on the smallest scale factor."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = (
    "corpus", "steps", "functions", "tokens", "token_classes", "block_pairs", "elements", "diagnostics", "outcomes",
    "findings", "file_report", "read_steps", "steps_do_splice", "lossless_documents", "lossless_pages", "write_report",
    "adjacent_duplicates_events", "after_terminator_all", "job_report", "job_summary", "function_index", "adjacent_duplicates", "after_terminator", "nesting_depth", "inside_block",
    "level_pairs_events", "adjacent_duplicates_urls", "findings_own", "rule_counts_own",
    "steps_by_content",
)


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, name, SF).startswith("ok")


def test_every_query_has_sql():
    extra = set(entry.llm.QUERIES) if entry.llm else set()
    assert set(entry.queries()) - extra == set(entry.oracle_sql()) - extra

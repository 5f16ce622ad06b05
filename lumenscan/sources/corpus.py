"""A corpus of source files derived from ``orders`` and ``lineitem``.

A fixed number of files per customer, dealt by the order key; one function per order group
of the file, one snippet per line item.  Nothing depends on how many lines a customer has,
so one who has very many gets ``shards`` very large files; no file is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.sources.snippets import DEFECTS, EPILOGUE, PRELUDE, SHARDS, SNIPPETS


def corpus_lines(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """One row per snippet: custkey, shard, fn and the columns that order it."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    sn = 1 + (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % len(SNIPPETS)
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("custkey"),
        (F.col("o_orderkey") % 3).cast("int").alias("fn"),
        F.floor(F.col("o_orderkey") / 3 % shards).cast("int").alias("shard"),
        "l_orderkey",
        "l_linenumber",
        sn.cast("int").alias("sn"),
    )


def _function(lines: Column, fn: int, snippets: Column) -> Column:
    mine = F.filter(lines, lambda s: s["fn"] == fn)
    body = F.array_join(F.transform(mine, lambda s: F.element_at(snippets, s["sn"])), "\n")
    header = F.format_string(f"function M.f%d_{fn}(x)\n", "custkey")
    return F.when(F.size(mine) > 0, F.concat(header, body, F.lit("\nend\n"))).otherwise("")


def script_corpus(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """``source_units`` of the derived corpus."""
    lines = corpus_lines(spark, sf_dir, shards)
    entry = F.struct("fn", "l_orderkey", "l_linenumber", "sn")
    files = lines.groupBy("custkey", "shard").agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    snippets = F.array(*[F.lit(s) for s in SNIPPETS])
    functions = [_function(F.col("lines"), fn, snippets) for fn in range(3)]
    empty = F.when(F.col("custkey") % 7 == 0, F.format_string("function M.e%d()\nend\n", "custkey")).otherwise("")
    defect = F.lit(None).cast("string")
    for modulus, rest, text in reversed(DEFECTS):
        defect = F.when(F.col("custkey") % modulus == rest, text).otherwise(defect)
    content = F.concat(F.lit(PRELUDE), *functions, empty, F.lit(EPILOGUE), F.coalesce(defect, F.lit("")))
    suffix = F.when(F.col("shard") > 0, F.format_string("_%d", "shard")).otherwise("")
    unit_id = F.concat(F.lit("src/c"), F.col("custkey").cast("string"), suffix, F.lit(".luau"))
    return files.select(
        unit_id.alias("unit_id"),
        unit_id.alias("location"),
        content.alias("content"),
        F.sha2(content, 256).alias("content_sha2"),
        F.lit(True).alias("valid_utf8"),
    )

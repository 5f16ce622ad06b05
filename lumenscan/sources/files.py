"""Source files in, reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.session import write_stage

SUFFIXES = (".luau", ".lua")
STEP_COLUMNS = (
    "unit_id", "fn_no", "fn_name", "step_no", "parent_no", "branch", "ordinal", "kind",
    "label", "condition", "header", "signature", "n_then", "n_else", "n_body", "line",
)


def decode_source(df: DataFrame) -> DataFrame:
    """Bytes to text; rows that are not UTF-8 stay, marked and without text."""
    valid = F.is_valid_utf8(F.col("content"))
    text = F.when(F.col("valid_utf8"), F.col("content").cast("string"))
    return (
        df.withColumn("valid_utf8", valid)
        .withColumn("content_sha2", F.sha2("content", 256))
        .withColumn("content", text)
        .select("unit_id", "location", "content", "content_sha2", "valid_utf8")
    )


def _located(df: DataFrame) -> DataFrame:
    path = _plain_path(F.col("path"))
    return decode_source(df.select(path.alias("unit_id"), path.alias("location"), "content"))


def _plain_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "/")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One file as one unit; the name must end in ``.luau`` or ``.lua``."""
    if not path.endswith(SUFFIXES):
        raise ValueError(f"expected a .luau or .lua file, got: {path}")
    df = spark.read.format("binaryFile").load(path)
    if len(df.inputFiles()) != 1 or not df.inputFiles()[0].endswith(path.rsplit("/", 1)[-1]):
        raise ValueError(f"path is not a file: {path}")
    return _located(df)


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``.luau``/``.lua`` files below ``root``; an error when there are none."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{luau,lua}")
        .load(root)
    )
    if df.select("path").isEmpty():
        raise ValueError(f"no .luau/.lua files found under: {root}")
    return _located(df)


def read_steps(df: DataFrame) -> DataFrame:
    """Step rows from elsewhere: checked, and completed by ``sub_end``, which is never taken as given.

    Read backwards, the next step of lower or equal depth ends a subtree.  Depth follows
    from the child counts: a step's subtree is the shortest run of later steps that
    provides all the children announced so far, which running sums find.
    """
    missing = [c for c in STEP_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"step table lacks columns: {missing}")
    return _with_sub_end(df.drop("sub_end"))


def _with_sub_end(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    # In preorder, let `owed` be the children announced but not yet seen, after a row:
    # sum(children - 1).  The subtree of a row is over where `owed` first falls to the
    # value before the row less one, so along one value of `owed` the rows pair up.
    children = F.col("n_then") + F.col("n_else") + F.col("n_body")
    file = W.partitionBy("unit_id", "fn_no").orderBy("step_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.withColumn("_after", F.sum(children - 1).over(file)).withColumn("_before", F.col("_after") - (children - 1))
    # A row asks at `_before - 1` and answers at `_after`; the next answer is its end.
    ask = F.struct((F.col("_before") - 1).alias("owed"), F.lit(True).alias("asks"))
    answer = F.struct(F.col("_after").alias("owed"), F.lit(False).alias("asks"))
    rows = rows.withColumn("_q", F.explode(F.array(ask, answer)))
    back = W.partitionBy("unit_id", "fn_no", "_q.owed").orderBy(F.col("step_no").desc(), F.col("_q.asks"))
    answered = F.when(~F.col("_q.asks"), F.col("step_no"))
    rows = rows.withColumn("sub_end", F.last(answered, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.filter("_q.asks").drop("_q", "_after", "_before")


def write_report(
    df: DataFrame, path: str, mode: str = "errorifexists", order_by: list[str] | None = None, parts: int | None = None
) -> None:
    """Write a report as JSON lines; null fields are written, not dropped.

    With ``order_by`` the files, read in the order of their names, hold the rows in that order:
    the rows are range-partitioned, so no task sorts more than its part.  They are stored first, as the
    cuts of the ranges are drawn from them: a report that is derived twice costs twice the time.
    """
    if order_by:
        df = write_stage(df, "report")
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)

"""Files to lexemes and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.batches import tokens as batch
from lumenscan.batches.lexemes import batches_of_files
from lumenscan.functions import lexicon as lx
from lumenscan.functions.windows import Ordered, ordered


def in_file() -> Ordered:
    return ordered(["unit_id"], ["n"])


# Text of a partition; a task holds about ten times as much in lexemes.
PARTITION_BYTES = 32 << 20


def text_partitions(units: DataFrame) -> int:
    """Partitions for ``units``, a stored table: PARTITION_BYTES of text each, and no fewer than the session's."""
    size = units.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    return max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def by_unit(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """The readable units, hash-partitioned on ``unit_id``.

    This is the only shuffle of the corpus, and it moves text rather than lexemes:
    exploding keeps the partitioning, so every later window finds its rows in place.  The
    number of partitions is stated because adaptive coalescing would size them by the
    text, not by the ten times larger lexemes; ``text_partitions`` derives it from the size.
    """
    n = partitions or int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "valid_utf8" in units.columns:
        units = units.filter("valid_utf8")
    return units.select("unit_id", "content").repartition(n, "unit_id")


def derived(
    units: DataFrame, partitions: int | None, derive: Callable[[list, list], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Rows that ``derive`` makes of the ids and contents of whole files, by the one shuffle of the text.

    Files with one id come together, in the order of the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, contents in batches_of_files(batches):
            yield from derive(ids, contents)

    rows = by_unit(units, partitions).select("unit_id", F.make_valid_utf8("content").alias("content"))
    return rows.sortWithinPartitions("unit_id").mapInArrow(run, schema)


def cut(units: DataFrame, pattern: str, partitions: int | None = None, shape: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """One row per match, in place: unit_id, n, raw (with trailing trivia), text.

    ``shape`` may change the array of a file's matches before they become rows.
    """
    content = F.col("content")
    pairs = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("raw"),
        F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("text"),
    )
    rows = by_unit(units, partitions).select("unit_id", pairs.alias("p"))
    rows = rows.select("unit_id", F.posexplode(shape(F.col("p"))).alias("n", "p")).select("unit_id", "n", "p.*")
    return rows.withColumn("nl", F.contains("raw", F.lit("\n")))


def positions() -> list[Column]:
    """Line (from 1) and offset (from 0) of a lexeme, from the lexemes before it."""
    before, zero = in_file().before, F.lit(0)
    breaks = F.when(F.col("nl"), F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))).otherwise(0)
    return [
        (F.coalesce(F.sum(breaks).over(before), zero) + 1).cast("int").alias("line"),
        F.coalesce(F.sum(F.length("raw")).over(before), zero).cast("int").alias("start"),
    ]


def with_column(rows: DataFrame) -> DataFrame:
    """Add ``col``, the offset in the line.  Plans that do not use it drop this pass."""
    last_line = F.col("start") + F.length("raw") - F.length(F.substring_index("raw", "\n", -1))
    line_start = F.max(F.when(F.col("nl"), last_line)).over(in_file().before)
    return rows.withColumn("col", F.col("start") - F.coalesce(line_start, F.lit(0)))


def tokens(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Default-channel tokens in order, with class, line, offset and column (from 0)."""
    rows = derived(units, partitions, batch.tokens_of, batch.TOKENS)
    rows._lexed_from = (units, partitions)
    return rows


def lexed_from(tokens: DataFrame) -> tuple[DataFrame, int | None] | None:
    """The units and partitions that all rows of ``tokens`` come from, if they are as ``tokens`` returned them.

    Operators over the tokens of a file then lex and go on in one batch; a table of tokens from elsewhere
    is passed over by windows.
    """
    return tokens.__dict__.get("_lexed_from")


def token_class(text: Column) -> Column:
    """Class of one lossless lexeme; the longest reading wins."""
    return (
        F.when(text.rlike(r"^\s"), "whitespace")
        .when(text.startswith("--"), "comment")
        .when(text.rlike("^[\"']"), "string")
        .when(text.startswith("`"), "interpolated")
        .when(text.rlike(r"^\[=*\["), "raw_string")
        .when(text.rlike(r"^\.?\d"), "number")
        .when(text.isin(*lx.KEYWORDS), "keyword")
        .when(text.rlike("^[A-Za-z_]"), "name")
        .when(text.rlike(f"^(?:{lx.OPERATOR})$"), "operator")
        .otherwise("other")
    )


def token_classes(units: DataFrame) -> DataFrame:
    """Lexeme counts per unit and class, whitespace and comments included.

    Counting needs no order, so there is no shuffle of the text: each file is cut where
    it is read and only the partial counts move.
    """
    if "valid_utf8" in units.columns:
        units = units.filter("valid_utf8")
    text = F.explode(F.regexp_extract_all("content", F.lit(lx.RAW_LEX), F.lit(0)))
    rows = units.select("unit_id", text.alias("text"))
    return (
        rows.select("unit_id", token_class(F.col("text")).alias("cls"))
        .groupBy("unit_id", "cls")
        .agg(F.count("*").alias("n_tokens"))
    )


def lossless(units: DataFrame) -> DataFrame:
    """Per unit the lexemes put together again, their number, and whether they are the text."""
    parts = F.regexp_extract_all("content", F.lit(lx.RAW_LEX), F.lit(0))
    joined = units.select("unit_id", "content", F.array_join(parts, "").alias("joined"), F.size(parts).alias("n_lexemes"))
    return joined.select(
        "unit_id", "joined", "n_lexemes", F.length("joined").cast("bigint").alias("n_chars"), (F.col("joined") == F.col("content")).alias("same")
    )

"""Lexical and balance problems of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.batches import tokens as batch
from lumenscan.functions import lexicon as lx
from lumenscan.operators.blocks import depths, is_kind, neighbours, numbered, partners
from lumenscan.operators.lexing import derived, in_file, lexed_from

_CLOSED_STRING, _NO_NAME = batch.CLOSED_STRING, batch.NO_NAME


def _no_header() -> Column:
    """At the first token behind ``function`` and its name: the word's place, if no bracket or no proper name is there."""
    text, file = F.col("text"), in_file()
    return F.when(~F.col("_part") & (F.col("_word.text") == "function"), F.when(
        ~text.isin("(", "<") | F.col("_prev").isin(".", ":") | F.coalesce(F.last(F.when(F.col("_odd"), F.col("n")), ignorenulls=True).over(file.to) > F.col("_word.n"), F.lit(False)),
        F.col("_word"),
    ))


def _with_headers(rows: DataFrame) -> DataFrame:
    """Add ``no_header`` (see ``_no_header``): a running look back along the file, without a sort of its own."""
    text, file = F.col("text"), in_file()
    part = text.isin(".", ":") | (text.rlike(f"^{lx.NAME}$") & ~text.isin(*_NO_NAME))
    rows = rows.withColumn("_part", part)
    rows = rows.select(
        "*",
        F.lag("text").over(file.all).alias("_prev"),
        F.lag("_part").over(file.all).alias("_prev_part"),
        F.last(F.when(~F.col("_part"), F.struct("text", "n", "line", "col")), ignorenulls=True).over(file.before).alias("_word"),
    )
    sign, prev_sign = text.isin(".", ":"), F.coalesce(F.col("_prev").isin(".", ":"), F.lit(True))
    odd = F.when(sign, prev_sign | ~F.col("_prev_part")).otherwise(F.col("_prev_part") & ~prev_sign)
    rows = rows.withColumn("_odd", F.coalesce(F.col("_part") & odd, F.lit(False)))
    return rows.withColumn("no_header", _no_header()).drop("_part", "_prev", "_prev_part", "_word", "_odd")


def problems(tokens: DataFrame) -> DataFrame:
    """Problems of each file, and one row for the last token of a file (``count``, without a message).

    Both come from one pass over the tokens.
    """
    if source := lexed_from(tokens):
        return derived(*source, batch.problems_of, batch.PROBLEMS)
    text = F.col("text")
    unterminated = text.rlike("^[\"'`]") & ~text.rlike(_CLOSED_STRING)
    last = F.lead("tok_no").over(in_file().all).isNull()
    rows = neighbours(_with_headers(numbered(tokens)), [F.when(last, F.col("tok_no") + 1).alias("count")])
    rows = rows.withColumn("bad_string", unterminated)
    keep = F.col("bad_string") | F.col("count").isNotNull() | F.col("no_header").isNotNull()
    # Most tokens are neither block words nor brackets; they have been seen by their neighbours and change no depth.
    rows = partners(depths(rows.filter(~is_kind(F.col("k"), "run") | keep)), keep=keep)
    bracket = F.when(F.col("pairs") == "bracket", " bracket").otherwise("")
    what = (
        F.when(F.col("pairs") == "other", F.when(F.col("bad_string"), "unterminated string"))
        .when(F.col("is_open") & F.coalesce("open_after", F.lit(True)), F.concat(F.lit("unclosed "), "pairs"))
        .when(~F.col("is_open") & ~F.coalesce("open_before", F.lit(False)), F.concat(F.lit("unexpected"), bracket))
    )
    message = F.concat(what, F.lit(" '"), "text", F.lit("'"))
    own = F.when(message.isNotNull() | F.col("count").isNotNull(), F.struct(message.alias("message"), "line", "col", "count"))
    none = F.lit(None).cast("int")
    header = F.when(F.col("no_header").isNotNull(), F.struct(F.lit("no header behind 'function'").alias("message"), "no_header.line", "no_header.col", none.alias("count")))
    return rows.select("unit_id", F.lit("error").alias("severity"), F.inline(F.array_compact(F.array(own, header))))


def diagnostics(tokens: DataFrame) -> DataFrame:
    """Unclosed blocks, unexpected closers, unbalanced brackets, unterminated strings, functions without a header."""
    return problems(tokens).filter("message is not null").drop("count")

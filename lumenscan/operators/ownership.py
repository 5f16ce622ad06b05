"""Who owns the text of a file: every scan lexeme belongs to one header, block word, step or separator.

The owners come from the same interval events that make the steps: what lies inside a named function
and in no step, and words that should open a function or a block and do not, belong to nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.windows import latest, ordered
from lumenscan.operators.blocks import OPENERS, is_kind
from lumenscan.operators.outline import MIN_CLOSURE_CHARS, lexeme_text, located

#: Owners, the first that holds. ``file`` is code outside all named functions, which has no steps.
OWNERS = ("header", "nobody", "step", "separator", "block", "file")


def _owner() -> Column:
    k = F.col("k")
    word = is_kind(k, *OPENERS) | F.col("whole")
    headed = is_kind(k, "function") & (F.col("sig") != "")
    stray = (is_kind(k, "function") & ~headed) | (word & F.col("closer_k").isNull())
    inside = F.col("nested") > 0
    empty = F.length("raw") == F.col("trail")
    block = ~is_kind(k, "run", ";", "(", ")", "[", "]", "{", "}")
    return (
        F.when(stray, "nobody")
        .when(headed, "header")
        .when(F.col("is_text"), "step")
        .when(is_kind(k, ";") | empty, "separator")
        .when(block, "block")
        .when(~inside, "file")
        .when(F.col("own_n") == F.col("ended"), "step")  # what follows a closure in its statement
        .otherwise("nobody")
    )


def ownership(units: DataFrame, min_closure_chars: int = MIN_CLOSURE_CHARS, partitions: int | None = None) -> DataFrame:
    """unit_id, fn_no, line, start, n_chars, text, owner: one row per scan lexeme, in place.

    ``n_chars`` counts the white space and comments behind the lexeme too, so the lexemes of a file
    add up to the file. ``fn_no`` is that of the named function around it, or null.
    """
    rows = located(units, min_closure_chars, partitions)
    closure_ends = (F.col("ev") == -1) & F.col("deco")
    rows = rows.withColumn("ended", latest(F.col("own_n"), closure_ends, ordered(["unit_id"], ["at"]).to))
    rows = rows.filter("ev = 0").withColumn("owner", _owner())
    fn_no = F.when(F.col("nested") > 0, F.col("fn_no"))
    return rows.select(
        "unit_id", fn_no.alias("fn_no"), "line", "start", F.length("raw").alias("n_chars"), lexeme_text().alias("text"), "owner"
    )


def unowned(units: DataFrame) -> DataFrame:
    """Problems: unit_id, severity, message, line of every lexeme that nobody owns."""
    rows = ownership(units).filter("owner = 'nobody'")
    message = F.concat(F.lit("belongs to no statement '"), "text", F.lit("'"))
    return rows.select("unit_id", F.lit("error").alias("severity"), message.alias("message"), "line")


def ownership_counts(units: DataFrame) -> DataFrame:
    """unit_id, n_chars of all its lexemes, and how many of them nobody owns."""
    return ownership(units).groupBy("unit_id").agg(
        F.sum("n_chars").alias("n_chars"), F.count_if(F.col("owner") == "nobody").alias("n_unowned")
    )

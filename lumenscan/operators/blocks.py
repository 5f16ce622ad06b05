"""Block and bracket depth of lexemes, and the pairs that depth defines.

Both lexers feed the same functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.batches import tokens as batch
from lumenscan.functions import lexicon as lx
from lumenscan.functions.lexicon import BRACKETS_CLOSE, BRACKETS_OPEN, CLOSERS, KINDS, OPENERS
from lumenscan.functions.windows import Ordered, ordered, set_aside, taken_back
from lumenscan.operators.lexing import derived, in_file, lexed_from

_CODES = {name: code for code, name in enumerate(KINDS)}


_END = "(?![A-Za-z0-9_])"


def code(name: str) -> int:
    return _CODES[name]


def is_kind(k: Column, *names: str) -> Column:
    return k.isin(*[_CODES[n] for n in names])


def on_level() -> Ordered:
    """Along one level; there an opener is directly followed by its closer."""
    return ordered(["unit_id", "xl"], ["n"])


def kinds(rows: DataFrame) -> DataFrame:
    """Add ``k`` and what else the text of a row alone says about blocks."""
    k, text = F.col("k"), F.col("text")
    rows = rows.withColumn("_word", F.regexp_extract(text, rf"^(?:[a-z]+{_END}|[;()\[\]{{}}]$)", 0))
    kind = F.lit(code("run"))
    for name in KINDS[1:]:
        kind = F.when(F.col("_word") == name, code(name)).otherwise(kind)
    # A header in one lexeme both starts its statement and opens its block.
    whole = is_kind(k, "if", "elseif", "while", "for") & text.rlike("(?:then|do)$")
    rows = rows.withColumn("k", kind).drop("_word").withColumn("whole", whole)
    # `return` may stand alone, and `>` may close a type.
    alone = text.rlike(r"(?:(?<![A-Za-z0-9_])return|>)$")
    leads = F.when(text.rlike(lx.EXPRESSION_LEAD), F.when(alone, 2).otherwise(1)).otherwise(0)
    return rows.withColumn("leads", leads)


def levels(rows: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """Depths of rows with unit_id, n, the columns of ``kinds``, and ``nl`` (a line break follows).

    Adds ``opens`` and ``closes`` a block (0 or 1); ``lev`` and ``br``, block and bracket
    depth after the row; ``xl``, the level the row is seen from (openers and closers count
    to the block around them); ``led``, whether the row before leaves an expression open
    (1 surely, 2 perhaps); and ``prev_k``, ``prev_opens``, ``prev_nl``.  ``also`` are further
    expressions over the file for the first pass.
    """
    return depths(neighbours(rows, also))


def neighbours(rows: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """The first pass of ``levels``: what rows say about the rows beside them, and the bracket depth."""
    k, file = F.col("k"), in_file()
    return rows.select(
        "*",
        F.lag("leads", 1, 0).over(file.all).alias("led"),
        F.lag("k").over(file.all).alias("_k"),
        F.lag("whole").over(file.all).alias("_whole"),
        F.lead("k").over(file.all).alias("_next"),
        F.lag("nl").over(file.all).alias("prev_nl"),
        F.sum(bracket_step(k)).over(file.to).cast("int").alias("br"),
        *also,
    )


def depths(rows: DataFrame) -> DataFrame:
    """The other passes of ``levels``, over the rows of ``neighbours``.

    A ``run`` changes no depth here: without the runs, all other rows get the same ``lev``, ``xl`` and ``br``.
    """
    k, file = F.col("k"), in_file()
    used = ("unit_id", "n", "k", "whole", "nl", "led", "prev_nl", "leads", "_k", "_whole", "_next")
    rows = set_aside(rows, [c for c in rows.columns if c not in used], "_others")
    # `if a then b else c` as a value has no `end`.  Such an `if` follows an operator, and
    # the next `else` completes it unless `if` follows on the same line.  How many are
    # open is a walk that never goes below zero: its sum less the lowest sum so far.
    # Headers that follow each other on a line, as `if a then if b then 1`, are all of the
    # kind of the first.
    headed = is_kind(F.col("_k"), "then") | (is_kind(F.col("_k"), "if") & F.col("_whole"))
    inner = is_kind(k, "if") & F.coalesce(headed & ~F.col("prev_nl"), F.lit(False))
    leads_on = (F.col("led") == 1) | ((F.col("led") == 2) & ~F.coalesce("prev_nl", F.lit(False)))
    first_led = F.last(F.when(is_kind(k, "if") & ~inner, leads_on), ignorenulls=True).over(file.to)
    rows = rows.withColumn("_first_led", first_led)
    value_if = is_kind(k, "if") & F.col("_first_led")
    chained = is_kind(k, "if") & F.coalesce(is_kind(F.col("_k"), "else") & ~F.col("prev_nl"), F.lit(False))
    goes_on = F.coalesce(is_kind(F.col("_next"), "if") & ~F.col("nl"), F.lit(False))
    rows = rows.withColumn("_v", value_if).withColumn("_c", chained)
    rows = rows.withColumn("_d", F.when(F.col("_v"), 1).when(is_kind(k, "else") & ~goes_on, -1).otherwise(0))
    rows = rows.withColumn("_walk", F.sum("_d").over(file.to))
    rows = rows.withColumn("_low", F.min(F.least("_walk", F.lit(0))).over(file.before))
    open_before = F.col("_walk") - F.col("_d") - F.coalesce("_low", F.lit(0))
    valued = F.col("_v") | ((F.col("_c") | is_kind(k, "then", "elseif", "else")) & (open_before > 0))
    rows = rows.withColumn("_valued", valued)
    # The words inside such a value go on with its statement.
    rows = rows.withColumn("goes_on", F.col("_valued") & is_kind(k, "then", "elseif", "else"))
    rows = rows.withColumn("k", F.when(F.col("_valued"), code("run")).otherwise(k))
    rows = rows.withColumn("whole", F.col("whole") & ~F.col("_valued"))
    rows = rows.withColumn("opens", (is_kind(k, *OPENERS) | F.col("whole")).cast("int"))
    rows = rows.withColumn("closes", is_kind(k, *CLOSERS).cast("int"))
    rows = rows.select(
        "*",
        F.sum(F.col("opens") - F.col("closes")).over(file.to).cast("int").alias("lev"),
        F.lag("k").over(file.all).alias("prev_k"),
        F.lag("opens", 1, 0).over(file.all).alias("prev_opens"),
    )
    scratch = ("leads", "_first_led", "_whole", "_k", "_next", "_v", "_c", "_d", "_walk", "_low", "_valued")
    return taken_back(rows.withColumn("xl", F.col("lev") - F.col("opens")).drop(*scratch), "_others")


def bracket_step(k: Column) -> Column:
    return F.when(is_kind(k, *BRACKETS_OPEN), 1).when(is_kind(k, *BRACKETS_CLOSE), -1).otherwise(0)


def numbered(tokens: DataFrame) -> DataFrame:
    """Public tokens as rows for ``levels``."""
    tokens = tokens.withColumn("n", F.col("tok_no"))
    return kinds(tokens.withColumn("nl", F.coalesce(F.lead("line").over(in_file().all) > F.col("line"), F.lit(True))))


def block_depth(tokens: DataFrame) -> DataFrame:
    """Block depth and bracket depth after every token."""
    if source := lexed_from(tokens):
        return derived(*source, batch.depths_of, batch.DEPTHS)
    return levels(numbered(tokens)).select(
        "unit_id", "tok_no", "text", F.col("lev").alias("depth"), F.col("br").alias("bracket_depth")
    )


def partners(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Block words and brackets, each beside its neighbours on its own level.

    Adds ``pairs`` (``block`` or ``bracket``), the level ``around``, whether the row opens,
    and for both neighbours on that level whether they open, with the next one's text and
    token number.  An opener is closed if the row after it closes, and the reverse.
    Rows that satisfy ``keep`` stay as well, under ``other``.
    """
    keep = F.lit(False) if keep is None else keep
    k = F.col("k")
    block, opens = is_kind(k, *OPENERS, *CLOSERS), is_kind(k, *OPENERS, *BRACKETS_OPEN)
    bracket = is_kind(k, *BRACKETS_OPEN, *BRACKETS_CLOSE)
    pairs = F.when(block, "block").when(bracket, "bracket").otherwise("other")
    rows = rows.filter(block | bracket | keep).select("*", pairs.alias("pairs"), opens.alias("is_open"))
    inner = F.when(F.col("is_open"), F.col("br") - 1).otherwise(F.col("br"))
    rows = rows.withColumn("around", F.when(F.col("pairs") == "block", F.col("xl")).otherwise(inner))
    level = ordered(["unit_id", "pairs", "around"], ["n"]).all
    return rows.select(
        "*",
        F.lag("is_open").over(level).alias("open_before"),
        F.lead("is_open").over(level).alias("open_after"),
        F.lead("text").over(level).alias("text_after"),
        F.lead("tok_no").over(level).alias("tok_after"),
    )


def block_pairs(tokens: DataFrame) -> DataFrame:
    """Opener and matching closer of blocks and brackets, with the level around them."""
    if source := lexed_from(tokens):
        return derived(*source, batch.pairs_of, batch.PAIRS)
    rows = partners(levels(numbered(tokens)))
    return rows.filter("is_open and not open_after").select(
        "unit_id",
        F.col("text").alias("opener"),
        F.col("text_after").alias("closer"),
        F.col("tok_no").alias("open_tok"),
        F.col("tok_after").alias("close_tok"),
        F.col("around").alias("level"),
    )

"""Functions and their control-flow steps, from block levels.

The stages are window passes over the lexemes of one file.  They all need the rows of a
file together and nothing else, so the hash partitioning on ``unit_id`` laid down under
the lexer serves every one of them: no stage shuffles, and none joins.

1. ``statements``: along each level, find where statements start and which statement
   owns each block.
2. ``_events``: every block becomes an *open* and a *close* event among the lexemes.
3. ``_places``: in file order, running sums of the events give the function, the depth
   and the step number of every row, and the step its text belongs to.
4. ``outline``: along each depth, the last open event is the parent; then, per step, one
   window gathers text, child counts and the end of its subtree.

Rows are copied in every pass, so they carry numbers: kinds are codes, and what a row
needs to know of another row is its position or one packed number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.batches import outlines
from lumenscan.functions import lexicon as lx
from lumenscan.functions.labels import compact, function_container
from lumenscan.functions.windows import latest, ordered, set_aside, taken_back
from lumenscan.operators.blocks import BRACKETS_CLOSE, bracket_step, code, is_kind, kinds, levels, on_level
from lumenscan.operators.headers import assembled
from lumenscan.operators.lexing import cut, derived, in_file, positions, with_column

# A closure with a shorter body stays in the text of its statement.
MIN_CLOSURE_CHARS = 60
_LOCAL = "^local(?![A-Za-z0-9_])"
# How a lexeme begins: as the rest of an expression, with `return`, or with another word.
_LED = r"^(?:(?:and|or)(?![A-Za-z0-9_])|[.:+\-*/%^=<>~,&|?])"
_RETURN = "^return(?![A-Za-z0-9_])"
_WORD = "^[A-Za-z_]"
_LED_CODE, _RETURN_CODE, _WORD_CODE = 1, 2, 3

K = lambda *names: is_kind(F.col("k"), *names)


def scan(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Scan lexemes with their depths; ``raw`` less ``trail`` characters is the text."""
    text, file = F.col("text"), in_file().all
    rows = kinds(cut(units, lx.SCAN_LEX, partitions, assembled)).select(
        "*",
        (F.length("raw") - F.length("text")).alias("trail"),
        F.when(text == "local", 2).when(text.rlike(_LOCAL), 1).otherwise(0).alias("local"),
        F.when(text.rlike(_LED), _LED_CODE).when(text.rlike(_RETURN), _RETURN_CODE).when(text.rlike(_WORD), _WORD_CODE).otherwise(0).alias("begins"),
    )
    prev = [F.lag(c, 1, 0).over(file).alias(f"prev_{c}") for c in ("trail", "local")]
    rows = with_column(levels(rows.drop("text"), [*positions(), *prev]))
    return rows.withColumn("prev_end", F.col("start") - F.col("prev_trail"))


def header_text(text: str) -> Column:
    """Of a function's lexeme: the header without its return type."""
    head = F.substring(text, F.lit(1), F.col("sig_end"))
    return compact(F.when(F.col("sig_end") > 0, head).otherwise(F.regexp_extract(text, f"^{lx.SIMPLE_HEADER}", 0)))


def lexeme_text() -> Column:
    return F.substring("raw", F.lit(1), F.length("raw") - F.col("trail"))


# A statement start packed into one number: position, kind, and whether `local` leads it.
def _pack_start() -> Column:
    local = F.when(F.col("local") > 0, 1).otherwise(0)
    return F.col("n").cast("bigint") * 64 + F.col("k") * 2 + local


def _own_kind(*names: str) -> Column:
    return F.floor(F.col("own") % 64 / 2).isin(*[code(n) for n in names])


def statements(units: DataFrame, partitions: int | None = None) -> DataFrame:
    """Scan lexemes with ``is_start`` and, for block openers, owner and closer."""
    level, file = on_level(), in_file().all
    rows = scan(units, partitions).withColumn("br_before", F.col("br") - bracket_step(F.col("k")))
    rows = rows.select("*", *[F.lag(c).over(file).alias(f"prev_{c}") for c in ("line", "col")])
    first_in_block = (F.col("prev_opens") == 1) & (F.col("closes") == 0)
    heads = K("if", "elseif", "while", "for") & ~F.col("whole")
    rows = rows.select(
        "*",
        F.coalesce(latest(F.col("br_before"), first_in_block, level.to), F.lit(0)).alias("base"),
        latest(F.col("n").cast("bigint") * 2 + heads.cast("int"), heads | K("then", "do"), level.before).alias("head"),
        F.lead(F.when(F.col("closes") == 1, F.col("k"))).over(level.all).alias("closer_k"),
        F.lead("n").over(level.all).alias("closer_n"),
        F.lead("prev_end").over(level.all).alias("body_end"),
        F.lead("start").over(level.all).alias("stop"),
        F.sum(K("elseif").cast("int")).over(level.to).cast("int").alias("elseifs"),
        latest(F.col("n"), K("function"), level.before).alias("fn_before"),
    )
    in_head = F.coalesce(F.col("head") % 2 == 1, F.lit(False))
    # On one line, a statement may follow `end` with any word, and anything with a word that
    # only begins statements.
    behind_end = is_kind(F.col("prev_k"), "end") & F.col("begins").isin(_RETURN_CODE, _WORD_CODE) & (F.col("prev_local") != 2)
    word = K("while", "for", "if") | (F.col("local") > 0) | (F.col("begins") == _RETURN_CODE)
    # An expression goes on over a line break if either side of it says so.
    broken = F.col("prev_nl") & ~((F.col("led") == 1) & (F.col("local") == 0)) & (F.col("begins") != _LED_CODE)
    boundary = (
        F.col("prev_k").isNull() | broken | (F.col("prev_opens") == 1) | is_kind(F.col("prev_k"), "else", ";") | behind_end | word
    )
    never = K("else", "end", "until", "then", "do", ";", *BRACKETS_CLOSE) | F.col("goes_on") | (F.length("raw") == F.col("trail"))
    is_start = K("elseif", "repeat") | (~in_head & (F.col("br_before") == F.col("base")) & boundary & ~never)
    rows = rows.withColumn("in_head", in_head).withColumn("is_start", F.coalesce(is_start, F.lit(False)))
    rows = rows.select(
        "*",
        latest(_pack_start(), F.col("is_start"), level.to).alias("own"),
        latest(F.col("elseifs"), F.col("is_start") & K("if"), level.to).alias("_at_if"),
    )
    link = F.when(K("elseif", "then"), F.coalesce(F.col("elseifs") - F.col("_at_if"), F.lit(0))).otherwise(0)
    return rows.withColumn("own_n", F.floor(F.col("own") / 64).cast("int")).withColumn("link", link)


_ROLES = {"block": 1, "splice": 2, "fn": 3, "drop": 4}


def _role(*names: str) -> Column:
    return F.coalesce(F.col("role").isin(*[_ROLES[n] for n in names]), F.lit(False))


def _roles(rows: DataFrame, min_closure_chars: int) -> DataFrame:
    """What a closed block is: ``block`` of a step, ``splice``, ``fn``, or ``drop``."""
    closed = (F.col("opens") == 1) & F.col("closer_k").isNotNull()
    heads = F.col("in_head") & (F.floor(F.col("head") / 2) == F.col("own_n"))
    owns = F.when(F.col("whole") | K("repeat"), F.col("is_start")).otherwise(K("then", "do") & heads)
    role = (
        F.when(~closed, None)
        .when(K("function"), _ROLES["fn"])
        .when(F.coalesce(owns, F.lit(False)), _ROLES["block"])
        .when(K("do") & ~F.col("in_head"), _ROLES["splice"])
        .otherwise(_ROLES["drop"])
    )
    body = F.col("body_end") - (F.col("start") + F.length("raw"))
    first_function = F.col("fn_before").isNull() | (F.col("fn_before") < F.col("own_n"))
    decomposes = (
        K("function")
        & (body >= min_closure_chars)
        & ~_own_kind("if", "elseif", "while", "for", "repeat")
        & ~F.col("in_head")
        & first_function
    )
    name = F.regexp_replace(F.regexp_extract("raw", lx.FUNCTION_NAME, lx.NAME_GROUP), r"\s+", "")
    named = K("function") & is_kind(F.col("closer_k"), "end") & (F.regexp_extract("raw", lx.FUNCTION_NAME, lx.NAME_GROUP) != "")
    return rows.select(
        "*",
        role.alias("role"),
        F.coalesce(decomposes, F.lit(False)).alias("deco"),
        F.when(named, name).alias("fn_name"),
    )


def _events(rows: DataFrame) -> DataFrame:
    """Lexemes plus an open and a close event per block, ordered by ``at``.

    ``at`` is four times the position, plus 1 for the lexeme, 2 for its open event, and
    for a close event 0 (before the closing lexeme) or 3 where the whole block stays in
    the text of a statement.
    """
    keeps_text = _role("drop") | (_role("fn") & ~F.col("deco"))
    n, closer = F.col("n").cast("bigint") * 4, F.col("closer_n").cast("bigint") * 4
    row = F.struct(F.lit(0).alias("ev"), (n + 1).alias("at"))
    opened = F.struct(F.lit(1).alias("ev"), (n + 2).alias("at"))
    closed = F.struct(F.lit(-1).alias("ev"), (closer + F.when(keeps_text, 3).otherwise(0)).alias("at"))
    some = F.when(F.col("role").isNotNull(), F.array(row, opened, closed)).otherwise(F.array(row))
    header = header_text("raw")
    local = (F.col("prev_local") == 2) & ~F.col("prev_nl")
    signature = F.when(local, F.concat(F.lit("local "), header)).otherwise(header)
    rows = rows.withColumn("sig", F.when(K("function"), signature)).select(
        "unit_id", "n", "k", "whole", "role", "deco", "fn_name", "sig", "link", "is_start", "line", "start",
        "stop", "raw", "trail", "closer_k", "own_n",
        (F.col("br_before") == F.col("base")).alias("at_base"),
        F.inline(some),
    )
    raw = F.when(F.col("ev") == 0, F.col("raw"))
    return rows.withColumn("raw", raw)


def _signed(when: Column, amount: Column | None = None) -> Column:
    by = F.col("ev") if amount is None else F.col("ev") * amount
    return F.when(when, by).otherwise(0)


def _places(rows: DataFrame) -> DataFrame:
    """Function, depth, step number and text owner of every lexeme and event."""
    ev, to = F.col("ev"), ordered(["unit_id"], ["at"]).to
    named = F.col("fn_name").isNotNull() & _role("fn")
    rows = set_aside(rows, ["whole", "sig", "line", "start", "stop", "raw", "trail", "at_base"], "_others")
    rows = rows.withColumn("nested", F.sum(_signed(named)).over(to).cast("int"))

    top = named & (ev != 0) & (F.col("nested") == F.when(ev == 1, 1).otherwise(0))
    in_fn = F.col("nested") > 0
    cont = (ev != 0) & in_fn & (_role("block") | (_role("fn") & F.col("deco") & ~top))
    drops = in_fn & (_role("drop") | (_role("fn") & ~F.col("deco") & ~top))
    rows = rows.select("*", top.alias("top"), cont.alias("cont"), drops.alias("drops"))
    top_open = F.col("top") & (ev == 1)
    rows = rows.select(
        "*",
        (F.sum(top_open.cast("int")).over(to) - 1).cast("int").alias("fn_no"),
        F.last(F.when(top_open, F.col("fn_name")), ignorenulls=True).over(to).alias("fn"),
        F.sum(_signed(F.col("drops"))).over(to).cast("int").alias("dropped"),
        F.sum(_signed(F.col("cont"), F.col("link") + 1)).over(to).cast("int").alias("depth"),
    )

    kept = F.col("dropped") == 0
    rows = rows.withColumn("is_step", (ev == 0) & F.col("is_start") & in_fn & kept)
    edge = (ev != 0) & (F.col("top") | F.col("cont") | _role("splice"))
    sink = (
        F.when(F.col("is_step"), F.col("n"))
        .when((ev == -1) & F.col("cont") & kept & is_kind(F.col("closer_k"), "until"), F.col("own_n"))
        .when(kept & (edge | ((ev == 0) & K("else"))), -1)
    )
    rows = rows.select(
        "*",
        F.sum(F.col("is_step").cast("int")).over(to).cast("int").alias("steps_so_far"),
        F.last(sink, ignorenulls=True).over(to).alias("sink"),
    )
    rows = rows.withColumn("_before", latest(F.col("steps_so_far"), top_open, to))
    # Steps of this function up to here; the newest one is number `count - 1`.
    rows = rows.withColumn("count", F.col("steps_so_far") - F.col("_before")).drop("_before", "steps_so_far", "drops")
    return taken_back(rows, "_others")


def _is_text() -> Column:
    """Does the lexeme belong to the label of its step?"""
    kept = F.col("dropped") == 0
    keyword = F.col("is_step") & ~F.col("whole") & K("if", "elseif", "while", "for", "repeat")
    own_header = F.col("is_step") & F.col("whole")
    block_word = K("end", "elseif", "else") | _role("block", "splice") | F.col("deco")
    separator = K(";") & F.col("at_base")
    hidden = keyword | (kept & ~own_header & (block_word | separator))
    return (F.col("ev") == 0) & F.coalesce(F.col("sink") >= 0, F.lit(False)) & ~hidden


def located(units: DataFrame, min_closure_chars: int = MIN_CLOSURE_CHARS, partitions: int | None = None) -> DataFrame:
    """Lexemes and block events with their function, depth, step number and text owner."""
    rows = _places(_events(_roles(statements(units, partitions), min_closure_chars)))
    return rows.withColumn("is_text", _is_text())


def outline(units: DataFrame, min_closure_chars: int = MIN_CLOSURE_CHARS, partitions: int | None = None) -> DataFrame:
    """Functions (``kind = 'function'``) and steps of every file, in one table.

    ``functions`` and ``steps`` are projections of it; write it once where both are needed.
    Closures whose body has at least ``min_closure_chars`` characters become steps; shorter
    ones stay in the text of their statement, and 0 makes steps of all.
    """
    def derive(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
        return outlines.outline_of(ids, contents, min_closure_chars)

    return derived(units, partitions, derive, outlines.SCHEMA)


STEP_COLUMNS = (
    "unit_id", "fn_no", "fn_name", "step_no", "sub_end", "parent_no", "branch", "ordinal", "kind",
    "label", "condition", "header", "signature", "n_then", "n_else", "n_body", "line",
)


def functions_of(outlined: DataFrame) -> DataFrame:
    """Named outermost functions, in file order."""
    container = function_container(F.col("fn_name")).alias("container")
    return outlined.filter("kind = 'function'").select(
        "unit_id", "fn_no", "fn_name", container, "signature", "line", "start", "stop"
    )


def steps_of(outlined: DataFrame) -> DataFrame:
    """The flat preorder step table."""
    return outlined.filter("kind <> 'function'").select(*STEP_COLUMNS)


def functions(units: DataFrame) -> DataFrame:
    return functions_of(outline(units))


def steps(units: DataFrame, min_closure_chars: int = MIN_CLOSURE_CHARS) -> DataFrame:
    return steps_of(outline(units, min_closure_chars))

"""One text lexed by many tasks, with the rows of the lexer of whole texts.

A text is cut at line breaks that no string, escape or run of white space goes across, so a long
bracket (a string or a comment) is all that can span a cut.  What a piece does to the mode it is
entered in is a small map: from code, and from each level of bracket that something in the piece
closes, to the head of the bracket that is open at its end, or to code; any other mode stays.  The
pieces find their maps on their own; the maps of a text, a row for each piece, are then composed in
order, which gives every piece the mode it is entered in, and it is lexed from there.

A bracket that nothing closes is no bracket to the lexer, so a piece must know which levels are
closed further on.  That is read off when the text is cut.  A token over several pieces is put
together from its parts, being one row of the result.

A line, with those that escapes join to it, is not divided.  Texts that are null or empty have no
rows; ``unit_id`` must be unique and not null; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenscan.batches import pieces as batch
from lumenscan.batches.tokens import TOKENS
from lumenscan.functions import lexicon as lx
from lumenscan.operators.lexing import text_partitions, token_class
from lumenscan.session import write_stage

# Characters of a piece, but for the rest of its last line.  A text is one value of less than 2 GB,
# so it has some two thousand pieces at most.
PIECE_CHARS = 1 << 20

_KEY = ["unit_id", "piece"]
_MODES = "array<struct<piece:int,head:string,owner:int>>"


def _line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def pieces(units: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """unit_id, piece, content, later, start and line of each piece, spread over the cluster by both keys.

    ``later`` are the levels (as their signs ``=``) that something in a later piece closes; ``start``
    and ``line`` count the characters and line breaks before the piece.
    """
    if piece_chars < 1:
        raise ValueError("a piece has one character at least")
    if "valid_utf8" in units.columns:
        units = units.filter("valid_utf8")
    cutter = rf"[\s\S]{{{piece_chars}}}[\s\S]*?{lx.SAFE_BREAK}|[\s\S]++"
    rows = units.select("unit_id", F.regexp_extract_all("content", F.lit(cutter), F.lit(0)).alias("texts"))
    rows = rows.select(
        "*",
        F.transform("texts", lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(lx.CLOSER), F.lit(1)))).alias("closed"),
        F.transform("texts", F.length).alias("chars"),
        F.transform("texts", _line_breaks).alias("breaks"),
    )

    def piece(text: Column, i: Column) -> Column:
        behind = F.slice("closed", i + 2, F.size("closed"))
        return F.struct(
            text.alias("content"),
            F.array_distinct(F.flatten(behind)).alias("later"),
            _sum(F.slice("chars", F.lit(1), i)).alias("start"),
            _sum(F.slice("breaks", F.lit(1), i)).alias("line"),
        )

    rows = rows.select("unit_id", F.posexplode(F.transform("texts", piece)).alias("piece", "p")).select(*_KEY, "p.*")
    return rows.repartition(text_partitions(units), *_KEY)


def _for_levels(pattern: str, later: Column) -> Column:
    levels = F.when(F.size(later) > 0, F.array_join(later, "|")).otherwise("(?!)")
    return F.replace(F.lit(pattern), F.lit(lx.LEVELS), levels)


def _behind(text: Column, level: Column) -> Column:
    """Characters of ``text`` up to the end of the first bracket that closes ``level``; null if there is none."""
    closer = F.concat(F.lit("]"), level, F.lit("]"))
    at = F.position(closer, text)
    return F.when(at > 0, at + F.length(closer) - 1)


def _from(text: Column, chars: Column) -> Column:
    return F.substring(text, chars + 1, F.length(text))


def transitions(cut: DataFrame) -> DataFrame:
    """unit_id, piece, from_code and from_level: the head left open at the end, empty for code, by the mode at the start."""
    text, pattern = F.col("content"), _for_levels(lx.OPEN_LEX, F.col("later"))

    def left_open(part: Column) -> Column:
        heads = F.regexp_extract_all(part, pattern, F.lit(lx.HEAD_GROUP))
        return F.coalesce(F.try_element_at(heads, F.lit(-1)), F.lit(""))

    levels = F.array_distinct(F.regexp_extract_all(text, F.lit(lx.CLOSER), F.lit(1)))
    maps = F.transform(levels, lambda k: F.struct(k.alias("level"), left_open(_from(text, _behind(text, k))).alias("head")))
    return cut.select(*_KEY, left_open(text).alias("from_code"), maps.alias("from_level"))


def entry_modes(maps: DataFrame) -> DataFrame:
    """unit_id, piece, head and owner: the bracket a piece is entered in, and the piece that opened it.

    The maps of a text are composed in order.  They are a few values for each piece, and a text has a
    bounded number of pieces.
    """
    entry = F.struct("piece", "from_code", "from_level")
    files = maps.groupBy("unit_id").agg(F.array_sort(F.collect_list(entry)).alias("maps"))
    start = F.struct(F.lit("").alias("head"), F.lit(-1).alias("owner"), F.array().cast(_MODES).alias("modes"))

    def step(s: Column, m: Column) -> Column:
        level = F.regexp_extract(s["head"], "=+", 0)
        closing = F.filter(m["from_level"], lambda x: x["level"] == level)
        stays = (s["head"] != "") & (F.size(closing) == 0)
        head = F.when(s["head"] == "", m["from_code"]).when(stays, s["head"]).otherwise(F.try_element_at(closing, F.lit(1))["head"])
        here = F.struct(m["piece"].alias("piece"), s["head"].alias("head"), s["owner"].alias("owner"))
        owner = F.when(stays, s["owner"]).otherwise(m["piece"])
        return F.struct(head.alias("head"), owner.alias("owner"), F.concat(s["modes"], F.array(here)).alias("modes"))

    modes = F.aggregate("maps", start, step, lambda s: s["modes"])
    return files.select("unit_id", F.inline(modes))


def _entered(units: DataFrame, piece_chars: int) -> DataFrame:
    """Pieces with their entry modes, as ``head`` and ``owner``.

    Both are written, the modes as a few narrow columns; what needs the lexemes of a piece lexes it anew, as they
    take several times the space of the text.
    """
    cut = write_stage(pieces(units, piece_chars), "pieces")
    return cut.join(write_stage(entry_modes(transitions(cut)), "entry_modes"), _KEY)


def tokens(units: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The rows of ``lexing.tokens``, from pieces."""
    rows = _entered(units, piece_chars)
    lexed = write_stage(rows.mapInArrow(batch.counts_of, batch.COUNTS), "lexed_pieces")
    in_text = W.partitionBy("unit_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    first = lexed.select(*_KEY, F.coalesce(F.sum("count").over(in_text), F.lit(0)).alias("first"))
    placed = rows.join(first, _KEY).join(_joined_parts(lexed), _KEY, "left")
    return placed.select("unit_id", "content", "later", "start", "line", "head", "first", "rest").mapInArrow(batch.tokens_of, TOKENS)


def _joined_parts(lexed: DataFrame) -> DataFrame:
    """What later pieces hold of the token that a piece leaves open, joined in order."""
    inside = lexed.filter("part is not null").select("unit_id", "owner", F.struct("piece", "part").alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return inside.groupBy("unit_id", F.col("owner").alias("piece")).agg(joined.alias("rest"))


def token_classes(units: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The rows of ``lexing.token_classes``, from pieces; a lexeme over several counts where it begins."""
    inside = F.coalesce(_behind(F.col("content"), F.regexp_extract("head", "=+", 0)), F.length("content"))
    rows = _entered(units, piece_chars).withColumn("skip", F.when(F.col("head") == "", 0).otherwise(inside))
    pattern = _for_levels(lx.raw_lex(in_piece=True), F.col("later"))
    found = F.explode(F.regexp_extract_all(_from(F.col("content"), F.col("skip")), pattern, F.lit(0)))
    rows = rows.select("unit_id", found.alias("text"))
    return rows.select("unit_id", token_class(F.col("text")).alias("cls")).groupBy("unit_id", "cls").agg(F.count("*").alias("n_tokens"))

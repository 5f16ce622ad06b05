"""Function headers put together from the lexemes that the scan lexer cuts them into.

A header that is not simple comes as ``function name(`` or ``function name<`` and the lexemes behind
it. It ends where the running depth of all its brackets, angle brackets included, is back at zero:
``>(`` closes one kind and opens another in one lexeme, so the depth is not zero between generic
parameters and the others. A return type follows up to the line break at depth zero. A word that
opens or closes a block cannot stand in a header; where one does, there is no header.

All of it happens in the array of a file's lexemes, before they become rows: a header ends before
the next ``function``, so each is looked for in its own stretch, and a file is passed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscan.functions import lexicon as lx

_OPEN = f"^{lx.OPEN_HEADER}$"
_STOPS = rf"^(?:{'|'.join(lx.BLOCK_WORDS)})(?![A-Za-z0-9_])|^;$"
_QUOTED = rf"{lx.STRING}|{lx.long_bracket('t')}"
# How far the search for the end of a header has come.
_PARAMETERS, _CLOSED, _TYPE, _OVER = 0, 1, 2, 3


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, signs: str) -> Column:
    return F.length(F.translate(text, signs, ""))


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed; an arrow closes none, and neither does a string."""
    bare = F.replace(F.regexp_replace(text, _QUOTED, ""), F.lit("->"), F.lit(""))
    return _named(bare, lambda b: (_without(b, ")]}>") - _without(b, "([{<")).cast("int"))


def _breaks(lexeme: Column) -> Column:
    return F.contains(lexeme["raw"], F.lit("\n"))


def _search(stretch: Column) -> Column:
    """Of the lexemes behind an open header: how many belong to it (``end``), and to its brackets (``closed``)."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(_PARAMETERS).alias("phase"), F.lit(1).alias("depth"), F.lit(False).alias("broke"),
        F.lit(0).alias("closed"), F.lit(0).alias("end"),
    )

    def step(s: Column, x: Column) -> Column:
        text = x["text"]
        typed = text.startswith(":") & ~text.startswith("::")
        at = s["at"] + 1

        def phase(seen: Column) -> Column:
            return (
                F.when(s["phase"] == _PARAMETERS, F.when(seen["stops"], _OVER).when(seen["depth"] <= 0, _CLOSED).otherwise(_PARAMETERS))
                .when(s["phase"] == _CLOSED, F.when(typed, _TYPE).otherwise(_OVER))
                .when(s["phase"] == _TYPE, F.when(seen["stops"] | (s["broke"] & (s["depth"] == 0)), _OVER).otherwise(_TYPE))
                .otherwise(_OVER)
            )

        def found(seen: Column) -> Column:
            return F.struct(
                at.alias("at"), seen["phase"].alias("phase"), seen["depth"].alias("depth"), _breaks(x).alias("broke"),
                F.when(seen["phase"] == _CLOSED, at).otherwise(s["closed"]).alias("closed"),
                F.when(seen["phase"].isin(_CLOSED, _TYPE), at).otherwise(s["end"]).alias("end"),
            )

        seen = F.struct((s["depth"] + _depth(text)).alias("depth"), text.rlike(_STOPS).alias("stops"))
        phased = _named(seen, lambda v: F.struct(v["depth"].alias("depth"), phase(v).alias("phase")))
        return F.when(s["phase"] == _OVER, s).otherwise(_named(phased, found))

    return F.aggregate(stretch, start, step, lambda s: F.struct(s["closed"], s["end"]))


def _joined(lexemes: Column) -> Column:
    return F.array_join(F.transform(lexemes, lambda x: x["raw"]), "")


def _lexeme(raw: Column, text: Column, head: Column) -> Column:
    return F.struct(raw.alias("raw"), text.alias("text"), head.cast("int").alias("sig_end"))


def _put_together(first: Column, stretch: Column, found: Column) -> Column:
    """The open header ``first`` and the lexemes up to the next one, with the header as one lexeme if there is one."""
    body = F.slice(stretch, F.lit(1), found["end"])
    raw = F.concat(first["raw"], _joined(body))
    last = F.element_at(body, -1)
    text = F.substring(raw, F.lit(1), F.length(raw) - (F.length(last["raw"]) - F.length(last["text"])))
    inside = F.slice(stretch, F.lit(1), found["closed"])
    close = F.element_at(inside, -1)
    head = F.length(first["raw"]) + F.length(_joined(inside)) - (F.length(close["raw"]) - F.length(close["text"]))
    rest = F.slice(stretch, found["end"] + 1, F.greatest(F.size(stretch) - found["end"], F.lit(0)))
    whole = F.concat(F.array(_lexeme(raw, text, head)), rest)
    # No header: the word with its name, and the bracket behind it.
    bracket = F.length(first["text"])
    word = F.substring(first["raw"], F.lit(1), bracket - 1)
    opened = F.substring(first["raw"], bracket, F.length(first["raw"]) - bracket + 1)
    parts = F.array(_lexeme(word, F.regexp_replace(word, r"\s+$", ""), F.lit(0)), _lexeme(opened, F.substring(first["text"], bracket, F.lit(1)), F.lit(0)))
    return F.when(found["end"] > 0, whole).otherwise(F.concat(parts, stretch))


def _is_open(text: Column) -> Column:
    """Is the lexeme an open header?  Its ends are compared first; few lexemes get as far as the pattern."""
    return text.startswith("function") & (text.endswith("(") | text.endswith("<")) & text.rlike(_OPEN)


def assembled(lexemes: Column) -> Column:
    """``lexemes`` (an array of raw, text) with every header as one of them, as an array of raw, text, sig_end.

    ``sig_end`` is the length of a header that was put together, up to the bracket that closes its
    parameters; simple ones and all other lexemes have 0.  The open headers are looked up once for a file,
    and each passes over its own stretch only, so the work grows with the lexemes.
    """
    zeros = F.array_repeat(F.lit(0), F.size(lexemes))
    plain = F.arrays_zip(lexemes["raw"].alias("raw"), lexemes["text"].alias("text"), zeros.alias("sig_end"))

    def put(rows: Column, places: Column) -> Column:
        def stretch(place: Column, nth: Column) -> Column:
            onward = F.coalesce(F.get(places, nth + 1), F.size(rows) + 1)
            behind = F.slice(rows, place + 1, onward - place - 1)
            return _named(
                F.struct(F.element_at(rows, place).alias("first"), behind.alias("rows"), _search(behind).alias("found")),
                lambda s: _put_together(s["first"], s["rows"], s["found"]),
            )

        ahead = F.slice(rows, F.lit(1), F.element_at(places, 1) - 1)
        return F.concat(ahead, F.flatten(F.transform(places, stretch)))

    def of(rows: Column) -> Column:
        places = F.filter(F.transform(rows, lambda x, i: F.when(_is_open(x["text"]), i + 1)), lambda i: i.isNotNull())
        return _named(places, lambda p: F.when(F.size(p) > 0, put(rows, p)).otherwise(rows))

    return _named(plain, of)

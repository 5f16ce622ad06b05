"""Tokens of a batch of files, their depths and pairs, and the problems of the files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumenscan.batches import patterns as px
from lumenscan.batches.levels import Levels, is_kind, levels
from lumenscan.batches.lexemes import Facts, Lexemes, Places, constants, cut, id_column, places, shifted
from lumenscan.batches.windows import Window, chosen, sorted_by
from lumenscan.functions import lexicon as lx
from lumenscan.functions.lexicon import BRACKETS_CLOSE, BRACKETS_OPEN, CLOSERS, OPENERS

CLASSES = ("comment", "string", "interpolated", "raw_string", "number", "keyword", "name", "operator", "other")
_CLASS = {name: code for code, name in enumerate(CLASSES)}
_RAW_STRING, _NUMBER, _NAMED, _NAME = px.java(r"^\[=*\["), px.java(r"^\.?\d"), px.java("^[A-Za-z_]"), px.java(f"^{lx.NAME}$")
_OPERATOR = px.java(f"^(?:{lx.OPERATOR})$")
# Words that are no part of a function's name.
NO_NAME = (*lx.BLOCK_WORDS, "and", "break", "false", "in", "nil", "not", "or", "true")
# A whole string by the rules of the lexer, without its way out at the end of a line.
CLOSED_STRING = "^(?:" + "|".join([lx.quoted('"', closed=True), lx.quoted("'", closed=True), lx.interpolated(2), lx.quoted("`", closed=True)]) + ")$"
_CLOSED = px.java(CLOSED_STRING)

TOKENS = "unit_id string, tok_no int, text string, cls string, line int, start int, col int"
DEPTHS = "unit_id string, tok_no int, text string, depth int, bracket_depth int"
PAIRS = "unit_id string, opener string, closer string, open_tok int, close_tok int, level int"
PROBLEMS = "unit_id string, severity string, message string, line int, col int, count int"


def _class(text: str) -> str:
    """``lexing.token_class``."""
    if text.startswith("--"):
        return "comment"
    if text[:1] in ("'", '"'):
        return "string"
    if text[:1] == "`":
        return "interpolated"
    if _RAW_STRING.match(text):
        return "raw_string"
    if _NUMBER.match(text):
        return "number"
    if text in lx.KEYWORDS:
        return "keyword"
    if _NAMED.match(text):
        return "name"
    return "operator" if _OPERATOR.match(text) else "other"


class TokenFacts(Facts):
    """Also the class of a token, and what ``diagnostics`` asks of its text."""

    def of(self, text: str) -> int:
        if not text:
            return 1 << 17
        sign = text in (".", ":")
        part = sign or (_NAME.match(text) is not None and text not in NO_NAME)
        bad = text[0] in "\"'`" and _CLOSED.match(text) is None
        return (
            super().of(text) | _CLASS[_class(text)] << 8 | part << 12 | sign << 13 | bad << 14 | (text == "function") << 15
            | (text in ("(", "<")) << 16
        )


class Tokens:
    """The tokens of a batch: lexemes with a text, numbered, with their places."""

    def __init__(self, ids: list, contents: list):
        x = cut(ids, contents, px.TOKENS, TokenFacts(), with_headers=False)
        file = Window(None, x.group)
        at = places(x, file)
        empty = shifted(x.fact, 17, 1)
        tok_no = x.n - (file.newest(empty == 1) >= 0)
        full = np.flatnonzero(empty == 0)
        self.lexemes, self.rows, self.tok_no, self.fact, self.group = x, full, tok_no[full], x.fact[full], x.group[full]
        self.places = Places(at.nl[full], at.line[full], at.start[full], at.col[full])
        self.file = Window(None, self.group)
        self.texts = x.texts if len(full) == len(x.texts) else [x.texts[i] for i in full]

    def levels(self) -> Levels:
        """``blocks.levels`` of ``blocks.numbered``: a line break follows a token if the next one is on a later line."""
        nl = self.file.is_last | (self.file.lead(self.places.line, 0) > self.places.line)
        return levels(self.fact, nl, self.file)

    def ids(self, rows: np.ndarray | None = None) -> pa.Array:
        return id_column(self.lexemes, self.rows if rows is None else self.rows[rows])

    def text(self, rows: np.ndarray) -> pa.Array:
        return pa.array([self.texts[i] for i in rows.tolist()], pa.string())


def _int32(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int32), mask=null)


def _batch(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in schema.split(", ")])


def tokens_of(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
    """``lexing.tokens``."""
    t = Tokens(ids, contents)
    p = t.places
    classes = constants(shifted(t.fact, 8, 15), list(CLASSES))
    yield _batch(TOKENS, t.ids(), _int32(t.tok_no), pa.array(t.texts, pa.string()), classes, _int32(p.line), _int32(p.start), _int32(p.col))


def depths_of(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
    """``blocks.block_depth``."""
    t = Tokens(ids, contents)
    at = t.levels()
    yield _batch(DEPTHS, t.ids(), _int32(t.tok_no), pa.array(t.texts, pa.string()), _int32(at.lev), _int32(at.br))


class Partners:
    """``blocks.partners``: block words and brackets beside their neighbours on their level, and rows to ``keep``."""

    def __init__(self, t: Tokens, keep: np.ndarray | None = None):
        at = t.levels()
        block, bracket = is_kind(at.k, *OPENERS, *CLOSERS), is_kind(at.k, *BRACKETS_OPEN, *BRACKETS_CLOSE)
        self.rows = rows = np.flatnonzero(block | bracket if keep is None else block | bracket | keep)
        self.block, self.bracket = block[rows], bracket[rows]
        self.is_open = is_kind(at.k[rows], *OPENERS, *BRACKETS_OPEN)
        self.around = np.where(self.block, at.xl[rows], at.br[rows] - self.is_open)
        pairs = np.where(self.block, 0, np.where(self.bracket, 1, 2))
        group = t.group[rows]
        level = Window(sorted_by(group, pairs, self.around), group, pairs, self.around)
        # Below zero: no neighbour.
        self.open_before, self.open_after = (move(self.is_open.astype(np.int64), -1) for move in (level.lag, level.lead))
        self.next = level.lead(np.arange(len(rows)), -1)


def pairs_of(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
    """``blocks.block_pairs``."""
    t = Tokens(ids, contents)
    p = Partners(t)
    found = np.flatnonzero(p.is_open & (p.open_after == 0))
    opener, closer = p.rows[found], p.rows[p.next[found]]
    yield _batch(
        PAIRS, t.ids(opener), t.text(opener), t.text(closer), _int32(t.tok_no[opener]), _int32(t.tok_no[closer]), _int32(p.around[found])
    )


def _without_header(t: Tokens) -> np.ndarray:
    """``diagnostics._with_headers``: at the first token behind ``function`` and its name the word's row, or -1."""
    part, sign = shifted(t.fact, 12, 1), shifted(t.fact, 13, 1) == 1
    prev_part, prev_sign = t.file.lag(part, -1), t.file.lag(sign.astype(np.int64), 1) == 1
    part = part == 1
    word = t.file.newest(~part, before=True)
    odd = part & np.where(sign, prev_sign | (prev_part == 0), (prev_part == 1) & ~prev_sign)
    newest_odd = t.file.newest(odd)
    number = chosen(t.tok_no, word, -1)
    bad = (shifted(t.fact, 16, 1) == 0) | prev_sign | ((newest_odd >= 0) & (chosen(t.tok_no, newest_odd, -1) > number))
    behind = ~part & (word >= 0) & (chosen(shifted(t.fact, 15, 1), word, 0) == 1)
    return np.where(behind & bad, word, -1)


def problems_of(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
    """``diagnostics.problems``."""
    t = Tokens(ids, contents)
    no_header = _without_header(t)
    bad_string, last = shifted(t.fact, 14, 1) == 1, t.file.is_last
    p = Partners(t, bad_string | last | (no_header >= 0))
    rows = p.rows
    unclosed, unexpected = p.is_open & (p.open_after != 0), ~p.is_open & (p.open_before != 1)
    other = ~(p.block | p.bracket)
    messages = []
    wrong = np.where(other, bad_string[rows], unclosed | unexpected)
    shown = np.flatnonzero(wrong | last[rows])
    for i in shown.tolist():
        if not wrong[i]:
            messages.append(None)
            continue
        pair = "bracket" if p.bracket[i] else "block"
        what = "unterminated string" if other[i] else f"unclosed {pair}" if p.is_open[i] else "unexpected bracket" if p.bracket[i] else "unexpected"
        messages.append(f"{what} '{t.texts[rows[i]]}'")
    headers = np.flatnonzero(no_header >= 0)
    words = no_header[headers]
    at = np.concatenate([rows[shown], words])
    count = np.concatenate([np.where(last[rows[shown]], t.tok_no[rows[shown]] + 1, -1), np.full(len(headers), -1)])
    message = pa.array(messages + ["no header behind 'function'"] * len(headers), pa.string())
    severity = constants(np.zeros(len(at), np.int64), ["error"])
    yield _batch(PROBLEMS, t.ids(at), severity, message, _int32(t.places.line[at]), _int32(t.places.col[at]), _int32(count, count < 0))

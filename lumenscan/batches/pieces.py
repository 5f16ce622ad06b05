"""Tokens of pieces of texts, each lexed from the mode it is entered in (``operators.pieces``)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lumenscan.batches import patterns as px
from lumenscan.batches.lexemes import BATCH_CHARS, constants, shifted
from lumenscan.batches.tokens import CLASSES, TOKENS, TokenFacts
from lumenscan.batches.windows import Window
from lumenscan.functions import lexicon as lx

COUNTS = "unit_id string, piece int, owner int, part string, count int"


@lru_cache(maxsize=256)
def _lexer(later: tuple[str, ...]) -> re.Pattern:
    """The lexer of a piece behind which brackets of the levels ``later`` are closed."""
    return px.java(lx.token_lex(in_piece=True).replace(lx.LEVELS, "|".join(later) if later else "(?!)"))


def entered(content: str, head: str) -> int:
    """Characters at the start that belong to the bracket that is open there."""
    if not head:
        return 0
    level = re.search("=*", head[head.index("[") + 1 :])[0]
    at = content.find(f"]{level}]")
    return len(content) if at < 0 else at + len(level) + 2


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Pieces, some ``BATCH_CHARS`` characters at a time."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["content"])
            if size >= BATCH_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens begin in each piece, and what it holds of a token that is open at its start."""
    for rows in _rows(batches):
        out: dict[str, list] = {"unit_id": [], "piece": [], "owner": [], "part": [], "count": []}
        for row in rows:
            skip = entered(row["content"], row["head"])
            found = _lexer(tuple(row["later"])).finditer(row["content"][skip:])
            part = row["content"][:skip] if row["head"].startswith("[") else None
            values = (row["unit_id"], row["piece"], row["owner"], part, sum(m.end(1) > m.start(1) for m in found))
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        types = {"unit_id": pa.string(), "part": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int32())) for c, v in out.items()], names=list(out))


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of pieces with ``first``, their number of tokens before, and ``rest``, what follows the last one elsewhere."""
    for rows in _rows(batches):
        yield _tokens(rows)


def _tokens(rows: list[dict]) -> pa.RecordBatch:
    texts: list[str] = []
    sizes: list[int] = []
    breaks: list[int] = []
    tails: list[int] = []  # characters behind the last line break, or -1
    counts, skips = [], []
    for row in rows:
        skip, had = entered(row["content"], row["head"]), len(texts)
        for m in _lexer(tuple(row["later"])).finditer(row["content"][skip:]):
            raw, text = m[0], m[1]
            texts.append(text)
            sizes.append(len(raw))
            number = raw.count("\n")
            breaks.append(number)
            tails.append(len(raw) - raw.rindex("\n") - 1 if number else -1)
        if len(texts) > had and row["rest"] is not None and texts[-1]:
            texts[-1] += row["rest"]
        counts.append(len(texts) - had)
        skips.append(skip)
    piece = np.repeat(np.arange(len(rows)), counts)
    window = Window(None, piece)
    size, number, tail = (np.array(v, np.int64) for v in (sizes, breaks, tails))
    at, behind = window.total(size) - size, window.total(number) - number
    facts = TokenFacts()
    fact = np.fromiter(map(facts.__getitem__, texts), np.int64, len(texts))
    full = np.fromiter(map(bool, texts), np.int64, len(texts))
    of = lambda name: np.array([r[name] for r in rows], np.int64)
    ahead = [r["content"][:s] for r, s in zip(rows, skips, strict=True)]
    lines = of("line") + np.array([a.count("\n") for a in ahead], np.int64)
    cols = np.array([len(a) - a.rfind("\n") - 1 for a in ahead], np.int64)
    newest = window.newest(tail >= 0, before=True)
    start = of("start") + np.array(skips, np.int64)
    col = np.where(newest >= 0, at - (at + size - tail)[newest], at + cols[piece]) if len(at) else at
    keep = np.flatnonzero(full)
    mine = piece[keep]
    columns = [
        (of("first")[piece] + window.total(full) - 1)[keep], (lines[piece] + behind + 1)[keep], (start[piece] + at)[keep], col[keep]
    ]
    number, line, place, col = (pa.array(c.astype(np.int32)) for c in columns)
    units = pa.array([rows[i]["unit_id"] for i in mine.tolist()], pa.string())
    kept = pa.array([texts[i] for i in keep.tolist()], pa.string())
    classes = constants(shifted(fact[keep], 8, 15), list(CLASSES))
    names = [c.split()[0] for c in TOKENS.split(", ")]
    return pa.RecordBatch.from_arrays([units, number, kept, classes, line, place, col], names=names)

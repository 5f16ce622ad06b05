"""Block and bracket depth of lexemes, and where statements start: ``operators.blocks`` and ``outline.statements``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenscan.batches.lexemes import KIND, Lexemes, Places, shifted
from lumenscan.batches.windows import Window, chosen, sorted_by
from lumenscan.functions.lexicon import BRACKETS_CLOSE, BRACKETS_OPEN, CLOSERS, OPENERS

# A truth value that is null, as SQL has it; a level that is.
NULL, NO_LEVEL = 2, -(1 << 40)


def is_kind(k: np.ndarray, *names: str) -> np.ndarray:
    table = np.zeros(len(KIND) + 1, bool)
    table[[KIND[n] for n in names]] = True
    return table[k]


def bracket_step(k: np.ndarray) -> np.ndarray:
    return is_kind(k, *BRACKETS_OPEN).astype(np.int64) - is_kind(k, *BRACKETS_CLOSE)


@dataclass
class Levels:
    """The columns of ``blocks.levels``; ``whole`` and ``opens`` may be NULL, ``xl`` is NO_LEVEL where ``opens`` is."""

    k: np.ndarray
    whole: np.ndarray
    led: np.ndarray
    goes_on: np.ndarray
    opens: np.ndarray
    closes: np.ndarray
    lev: np.ndarray
    br: np.ndarray
    xl: np.ndarray
    prev_k: np.ndarray  # below zero: none
    prev_opens: np.ndarray
    prev_nl: np.ndarray  # NULL: none


def levels(fact: np.ndarray, nl: np.ndarray, file: Window) -> Levels:
    """``blocks.levels``, pass by pass."""
    k, whole, leads = fact & 31, shifted(fact, 5, 1), shifted(fact, 6, 3)
    led, last_k, last_whole = file.lag(leads, 0), file.lag(k, -1), file.lag(whole, 0)
    next_k, prev_nl = file.lead(k, -1), file.lag(nl.astype(np.int64), NULL)
    br = file.total(bracket_step(k))
    is_if, on_line = is_kind(k, "if"), prev_nl == 0
    headed = is_kind(last_k, "then") | (is_kind(last_k, "if") & (last_whole == 1))
    inner = is_if & headed & on_line
    leads_on = (led == 1) | ((led == 2) & (prev_nl != 1))
    first_led = chosen(leads_on.astype(np.int64), file.newest(is_if & ~inner), NULL)
    value_if, unknown = is_if & (first_led == 1), is_if & (first_led == NULL)
    chained = is_if & is_kind(last_k, "else") & on_line
    goes_on = is_kind(next_k, "if") & ~nl
    step = np.where(value_if, 1, np.where(is_kind(k, "else") & ~goes_on, -1, 0))
    walk = file.total(step)
    open_before = walk - step - file.least_before(np.minimum(walk, 0))
    valued = value_if | ((chained | is_kind(k, "then", "elseif", "else")) & (open_before > 0))
    unknown &= ~valued
    goes_on = valued & is_kind(k, "then", "elseif", "else")
    k = np.where(valued, KIND["run"], k)
    whole = np.where((whole == 1) & unknown, NULL, whole & ~valued)
    opens = np.where(is_kind(k, *OPENERS), 1, whole)
    closes = is_kind(k, *CLOSERS).astype(np.int64)
    lev = file.total(np.where(opens == NULL, 0, opens - closes))
    xl = np.where(opens == NULL, NO_LEVEL, lev - opens)
    return Levels(k, whole, led, goes_on, opens, closes, lev, br, xl, file.lag(k, -1), file.lag(opens, 0), prev_nl)


@dataclass
class Statements:
    """The columns of ``outline.statements``; a number below zero is none, but for ``own_n`` see ``own``."""

    at: Levels
    places: Places
    local: np.ndarray
    prev_local: np.ndarray
    trail: np.ndarray
    at_base: np.ndarray
    in_head: np.ndarray
    head_n: np.ndarray
    is_start: np.ndarray
    own: np.ndarray  # the row of the start, or -1
    own_n: np.ndarray
    link: np.ndarray
    closer_k: np.ndarray
    closer_n: np.ndarray
    body_end: np.ndarray
    stop: np.ndarray
    fn_before: np.ndarray
    rank: np.ndarray | None  # place along the levels, where ids are doubled


def statements(x: Lexemes, places: Places, file: Window) -> Statements:
    """``outline.statements`` over the rows of a batch."""
    at = levels(x.fact, places.nl, file)
    k, n, local, begins = at.k, x.n, shifted(x.fact, 8, 3), shifted(x.fact, 10, 3)
    trail = x.stop - x.end
    prev_local = file.lag(local, 0)
    prev_end = places.start - file.lag(trail, 0)
    br_before = at.br - bracket_step(k)
    order = sorted_by(x.group, at.xl)
    level = Window(order, x.group, at.xl)
    rank = None
    if x.doubled:
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
    base = chosen(br_before, level.newest((at.prev_opens == 1) & (at.closes == 0)), 0)
    heads = is_kind(k, "if", "elseif", "while", "for") & (at.whole == 0)
    head = level.newest(heads | is_kind(k, "then", "do"), before=True)
    in_head = chosen(heads.astype(np.int64), head, 0) == 1
    elseifs = level.total(is_kind(k, "elseif"))
    behind_end = is_kind(at.prev_k, "end") & (begins >= 2) & (prev_local != 2)
    word = is_kind(k, "while", "for", "if") | (local > 0) | (begins == 2)
    broken = (at.prev_nl == 1) & ~((at.led == 1) & (local == 0)) & (begins != 1)
    boundary = (at.prev_k < 0) | broken | (at.prev_opens == 1) | is_kind(at.prev_k, "else", ";") | behind_end | word
    never = is_kind(k, "else", "end", "until", "then", "do", ";", *BRACKETS_CLOSE) | at.goes_on | (x.begin == x.end)
    at_base = br_before == base
    is_start = is_kind(k, "elseif", "repeat") | (~in_head & at_base & boundary & ~never)
    own, at_if = level.newest(is_start), level.newest(is_start & is_kind(k, "if"))
    link = np.where(is_kind(k, "elseif", "then") & (at_if >= 0), elseifs - chosen(elseifs, at_if, 0), 0)
    return Statements(
        at, places, local, prev_local, trail, at_base, in_head, chosen(n, head, -1), is_start, own, chosen(n, own, -1), link,
        level.lead(np.where(at.closes == 1, k, -1), -1), level.lead(n, -1), level.lead(prev_end, -1), level.lead(places.start, -1),
        chosen(n, level.newest(is_kind(k, "function"), before=True), -1), rank,
    )

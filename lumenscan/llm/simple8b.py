"""Simple-8b: whole numbers in 64-bit words, a selector in the top four bits of each."""

from __future__ import annotations

import numpy as np

#: Selector i + 1 stands for (values, bits of each); fixed values of the format.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: The word of a value of more than 60 bits has this selector and the value's place among the escapes.
ESCAPE = 15

_BODY = np.uint64(2**60 - 1)
_COUNTS = np.array([0, *(n for n, _ in SELECTORS), 1], np.int64)


_SHORT = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits that each value needs."""
    out = _SHORT[values & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        rest = (values >> np.uint64(shift)) & np.uint64(0xFFFF)
        if rest.any():
            out = np.where(rest > 0, _SHORT[rest] + np.uint8(shift), out)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escapes of ``values`` (uint64). Each word takes as many values as fit."""
    values = np.ascontiguousarray(values, np.uint64)
    total = len(values)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # The width of the widest of the next 1, 2, 4, ... values; past the end stand zeros, which fit anywhere.
    widest = {1: np.concatenate((_widths(values), np.zeros(60, np.uint8)))}
    for span in (1, 2, 4, 8, 16):
        have = widest[span]
        widest[2 * span] = np.maximum(have[: len(have) - span], have[span:])
    choice = np.full(total, ESCAPE, np.uint8)
    for selector in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[selector - 1]
        have = widest[span := 1 << (count.bit_length() - 1)]
        most = np.maximum(have[:total], have[count - span : count - span + total])
        choice[most <= bits] = selector
    onward, at, begins = (np.arange(total) + _COUNTS[choice]).tolist(), 0, []
    append = begins.append
    while at < total:
        append(at)
        at = onward[at]
    begin = np.array(begins, np.int64)
    chosen = choice[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(60, np.uint64)))
    for selector, (count, bits) in enumerate(SELECTORS, 1):
        if len(mine := np.flatnonzero(chosen == selector)):
            block = padded[begin[mine, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[mine] |= np.bitwise_or.reduce(block, axis=1)
    mine = np.flatnonzero(chosen == ESCAPE)
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    return words, values[begin[mine]]


def group_offsets(words: np.ndarray, group: int) -> np.ndarray:
    """The number of values in front of each group of ``group`` words."""
    before = np.concatenate(([0], np.cumsum(_COUNTS[(words >> np.uint64(60)).astype(np.int64)])))
    return before[:-1][::group].astype(np.uint32)


def decode(words: np.ndarray, escapes: np.ndarray, total: int) -> np.ndarray:
    """The ``total`` values of ``words``, one vector operation for each selector."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    if len(chosen) and not chosen.all():
        raise ValueError("a word has no selector")
    ends = np.cumsum(_COUNTS[chosen])
    if (int(ends[-1]) if len(ends) else 0) < total:
        raise ValueError("values are missing")
    begin = ends - _COUNTS[chosen]
    out = np.zeros((int(ends[-1]) if len(ends) else 0) + 60, np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS, 1):
        if len(mine := np.flatnonzero(chosen == selector)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[begin[mine, None] + np.arange(count)] = ((words[mine] & _BODY)[:, None] >> shifts) & np.uint64(2**bits - 1)
    mine = np.flatnonzero(chosen == ESCAPE)
    out[begin[mine]] = escapes[(words[mine] & _BODY).astype(np.int64)]
    return out[:total]


def decode_group(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, group: int, first: int, last: int, total: int) -> np.ndarray:
    """Values ``first`` to ``last`` alone: only the groups of words that hold them are decoded."""
    if last <= first:
        return np.zeros(0, np.uint64)
    low = int(np.searchsorted(offsets, first, side="right")) - 1
    high = int(np.searchsorted(offsets, last, side="left"))
    stop = int(offsets[high]) if high < len(offsets) else total
    base = int(offsets[low])
    return decode(words[low * group : high * group], escapes, stop - base)[first - base : last - base]

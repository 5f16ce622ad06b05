"""A batch of files as scan lexemes or tokens, with what the text of a lexeme alone says."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lumenscan.batches import patterns as px
from lumenscan.batches.windows import Window
from lumenscan.functions import lexicon as lx
from lumenscan.functions.lexicon import KINDS
from lumenscan.operators import headers

# Characters of a batch; a file is never divided.
BATCH_CHARS = 2 << 20

KIND = {name: number for number, name in enumerate(KINDS)}
_WORD = px.java(r"^(?:[a-z]+(?![A-Za-z0-9_])|[;()\[\]{}]$)".replace("$", px._END))
_HEADED = tuple(KIND[k] for k in ("if", "elseif", "while", "for"))
_WHOLE = px.java("(?:then|do)$")
_LEAD, _ALONE = px.java(lx.EXPRESSION_LEAD), px.java(r"(?:(?<![A-Za-z0-9_])return|>)$")


class Facts(dict):
    """What ``blocks.kinds`` says of a text, in one number; kept for the texts of a batch."""

    def __missing__(self, text: str) -> int:
        self[text] = fact = self.of(text)
        return fact

    def of(self, text: str) -> int:
        word = _WORD.match(text)
        kind = KIND.get(word[0], 0) if word else 0
        whole = kind in _HEADED and _WHOLE.search(text) is not None
        leads = 0
        # The word `return`, the sign before it and a line break behind it are nine characters.
        if _LEAD.search(tail := text[-12:]):
            leads = 2 if _ALONE.search(tail) else 1
        return kind | whole << 5 | leads << 6


def shifted(facts: np.ndarray, by: int, mask: int) -> np.ndarray:
    return (facts >> by) & mask


_LOCAL = px.java("^local(?![A-Za-z0-9_])")
_LED = px.java(r"^(?:(?:and|or)(?![A-Za-z0-9_])|[.:+\-*/%^=<>~,&|?])")
_RETURN, _NAMED = px.java("^return(?![A-Za-z0-9_])"), px.java("^[A-Za-z_]")
_OPEN = px.java(headers._OPEN)
_STOPS = px.java(rf"^(?:{'|'.join(lx.BLOCK_WORDS)})(?![A-Za-z0-9_])")
_QUOTED = px.java(headers._QUOTED)


class ScanFacts(Facts):
    """Also ``local`` and ``begins`` of ``outline.scan``, and whether the text is an open header."""

    def of(self, text: str) -> int:
        local = 2 if text == "local" else 1 if _LOCAL.match(text) else 0
        begins = 1 if _LED.match(text) else 2 if _RETURN.match(text) else 3 if _NAMED.match(text) else 0
        is_open = text.startswith("function") and text.endswith(("(", "<")) and _OPEN.match(text) is not None
        return super().of(text) | local << 8 | begins << 10 | is_open << 12


@dataclass
class Lexemes:
    """Lexemes of files in order; ``begin``, ``end`` (of the text) and ``stop`` (with trivia) are places in ``joined``."""

    ids: list  # of the files
    joined: str
    file: np.ndarray  # files with one id are one group
    group: np.ndarray
    texts: list[str]
    fact: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    stop: np.ndarray
    sig_end: np.ndarray
    n: np.ndarray  # in the file
    doubled: bool  # has an id several files?

    def raw(self, row: int) -> str:
        return self.joined[self.begin[row] : self.stop[row]]


def _groups(ids: list) -> np.ndarray:
    """Numbers of files, the same for neighbours with one id."""
    return np.cumsum([0, *(a != b for a, b in zip(ids[1:], ids))])[: len(ids)] if ids else np.zeros(0, np.int64)


def cut(ids: list, contents: list[str | None], pattern, facts: Facts, with_headers: bool) -> Lexemes:
    """The lexemes of files; those of files with one id are mixed by their numbers, as windows over the id would."""
    contents = [c or "" for c in contents]
    texts: list[str] = []
    sizes: list[int] = []
    counts = []
    for content in contents:
        found = pattern.findall(content)
        texts += [m[1] for m in found]
        sizes += [len(m[0]) for m in found]
        counts.append(len(found))
    file = np.repeat(np.arange(len(contents)), np.array(counts, np.int64))
    stop = np.cumsum(np.array(sizes, np.int64))
    begin = np.append(0, stop[:-1])[: len(stop)]
    end = begin + np.fromiter(map(len, texts), np.int64, len(texts))
    fact = np.fromiter(map(facts.__getitem__, texts), np.int64, len(texts))
    joined, sig_end = "".join(contents), np.zeros(len(texts), np.int64)
    if with_headers and (fact >> 12 & 1).any():
        file, texts, fact, begin, end, stop, sig_end = _assembled(joined, file, texts, fact, begin, end, stop, facts)
    group = _groups(ids)[file] if len(file) else file
    n = Window(None, file).index - Window(None, file).first
    doubled = bool(len(ids) > 1 and (_groups(ids)[-1] + 1 < len(ids)))
    if doubled:
        order = np.lexsort((np.arange(len(n)), n, group))
        file, group, n, fact, begin, end, stop, sig_end = (x[order] for x in (file, group, n, fact, begin, end, stop, sig_end))
        texts = [texts[i] for i in order]
    return Lexemes(ids, joined, file, group, texts, fact, begin, end, stop, sig_end, n, doubled)


def _search(joined: str, texts: list[str], begin: np.ndarray, stop: np.ndarray, rows: range) -> tuple[int, int]:
    """``headers._search``: of the lexemes behind an open header, how many belong to its brackets, and to it."""
    phase, depth, broke, closed, found = headers._PARAMETERS, 1, False, 0, 0
    for at, row in enumerate(rows, 1):
        text = texts[row]
        stops = text == ";" or _STOPS.match(text) is not None
        if phase == headers._CLOSED:
            phase = headers._TYPE if text.startswith(":") and not text.startswith("::") else headers._OVER
        elif phase == headers._TYPE and (stops or (broke and depth == 0)):
            phase = headers._OVER
        bare = _QUOTED.sub("", text).replace("->", "")
        depth += sum(map(bare.count, "([{<")) - sum(map(bare.count, ")]}>"))
        if phase == headers._PARAMETERS:
            phase = headers._OVER if stops else headers._CLOSED if depth <= 0 else phase
            closed = at if phase == headers._CLOSED else closed
        if phase == headers._OVER:
            break
        if phase in (headers._CLOSED, headers._TYPE):
            found = at
        broke = joined.find("\n", begin[row], stop[row]) >= 0
    return closed, found


def _assembled(joined, file, texts, fact, begin, end, stop, facts):
    """``headers.assembled``: every open header with what belongs to it as one lexeme, or as the word and its bracket."""
    places = np.flatnonzero(fact >> 12 & 1)
    onward = np.append(places[1:], len(texts))
    last = np.searchsorted(file, file[places], side="right")
    keep = np.ones(len(texts), bool)
    sig_end, new = np.zeros(len(texts), np.int64), []
    end, stop = end.copy(), stop.copy()
    for place, until in zip(places.tolist(), np.minimum(onward, last).tolist()):
        closed, found = _search(joined, texts, begin, stop, range(place + 1, until))
        if found:
            keep[place + 1 : place + found + 1] = False
            sig_end[place] = end[place + closed] - begin[place]
            end[place], stop[place] = end[place + found], stop[place + found]
        else:
            bracket = int(end[place]) - 1
            new.append((place + 1, bracket, bracket + 1, int(stop[place])))
            stop[place] = bracket
            end[place] = begin[place] + len(px.without_last_spaces(joined[begin[place] : bracket]))
        texts[place] = joined[begin[place] : end[place]]
        fact[place] = facts[texts[place]]
    if new:
        at = np.array([x[0] for x in new])
        file = np.insert(file, at, file[at - 1])
        keep = np.insert(keep, at, True)
        sig_end = np.insert(sig_end, at, 0)
        fact = np.insert(fact, at, [facts[joined[b:e]] for _, b, e, _ in new])
        begin, end, stop = (np.insert(x, at, [row[i] for row in new]) for i, x in ((1, begin), (2, end), (3, stop)))
        out, last_at = [], 0
        for place, b, e, _ in new:
            out += texts[last_at:place]
            out.append(joined[b:e])
            last_at = place
        texts = out + texts[last_at:]
    if not keep.all():
        texts = [texts[i] for i in np.flatnonzero(keep)]
        file, fact, begin, end, stop, sig_end = (x[keep] for x in (file, fact, begin, end, stop, sig_end))
    return file, texts, fact, begin, end, stop, sig_end


@dataclass
class Places:
    """Line (from 1), offset and column of lexemes; ``nl``: a line break follows."""

    nl: np.ndarray
    line: np.ndarray
    start: np.ndarray
    col: np.ndarray


def places(lexemes: Lexemes, file: Window) -> Places:
    """``lexing.positions`` and ``with_column``."""
    breaks = np.flatnonzero(np.frombuffer(lexemes.joined.encode("utf-32-le"), np.uint32) == 10)
    upto = np.searchsorted(breaks, lexemes.stop)
    number = upto - np.searchsorted(breaks, lexemes.begin)
    nl, length = number > 0, lexemes.stop - lexemes.begin
    line = file.total(number) - number + 1
    start = file.total(length) - length
    behind = np.where(nl, (breaks[upto - 1] if len(breaks) else 0) + 1 - lexemes.begin, 0)
    newest = file.newest(nl, before=True)
    line_start = np.where(newest >= 0, (start + behind)[newest], 0) if len(start) else start
    return Places(nl, line, start, start - line_start)


def batches_of_files(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list]]:
    """Ids and contents of whole files, some ``limit`` characters at a time; files with one id stay together."""
    ids: list = []
    contents: list = []
    held = 0
    for batch in batches:
        for unit, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held > limit and unit != ids[-1]:
                yield ids, contents
                ids, contents, held = [], [], 0
            ids.append(unit)
            contents.append(content)
            held += len(content or "")
    if ids:
        yield ids, contents


def constants(codes: np.ndarray, names: list) -> pa.Array:
    """The names that ``codes`` stand for; a code below zero is null."""
    index = pa.array(np.maximum(codes, 0).astype(np.int32), mask=codes < 0)
    return pa.DictionaryArray.from_arrays(index, pa.array(names, pa.string())).dictionary_decode()


def id_column(lexemes: Lexemes, rows: np.ndarray) -> pa.Array:
    index = pa.array(lexemes.file[rows].astype(np.int32))
    return pa.DictionaryArray.from_arrays(index, pa.array(lexemes.ids, pa.string())).dictionary_decode()

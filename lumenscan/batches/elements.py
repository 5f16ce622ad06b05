"""Structural elements of a batch of files: the passes of ``operators.elements`` over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumenscan.batches import patterns as px
from lumenscan.batches.levels import is_kind, statements
from lumenscan.batches.lexemes import Lexemes, ScanFacts, cut, places
from lumenscan.batches.windows import Window, sorted_by
from lumenscan.functions import lexicon as lx

SCHEMA = "unit_id string, elem_no int, kind string, name string, line int, col int, container string, signature string"
# What a list of bindings is made of; a type holds brackets, arrows and string literals.
_PART = px.java(rf"->|{lx.NAME}|{lx.STRING}|[(\[{{<]|[)\]}}>]|[,:=]")
_LOCAL = px.java(r"^local(?![A-Za-z0-9_])")
_TYPE = px.java(rf"^(?:export\s+)?type\s+({lx.NAME})\s*(?:<[^=]*>)?\s*=")


def bindings(text: str) -> tuple[list[str], bool]:
    """Of ``local a: T, b = ...``: the names bound, and whether a value is assigned.

    The parts are read in order with the bracket depth, so types of any depth hide neither a
    comma nor ``=``, and a name is what stands first behind ``local`` or a comma.
    """
    depth, awaits, names = 0, False, []
    for found in _PART.finditer(text):
        part = found[0]
        if depth == 0:
            if awaits and (part[0] == "_" or (part[0].isascii() and part[0].isalpha())):
                names.append(part)
            if part == "=":
                return names, True
            awaits = part in (",", "local")
        depth += (part in ("(", "[", "{", "<")) - (part in (")", "]", "}", ">"))
    return names, False


def elements_of(ids: list, contents: list) -> Iterator[pa.RecordBatch]:
    """``elements.elements`` of whole files."""
    x = cut(ids, contents, px.SCANNED, ScanFacts(), with_headers=True)
    if len(x.texts):
        yield _elements(x)


def _bound(x: Lexemes, s, function: np.ndarray) -> dict[int, tuple[list[str], bool]]:
    """The bindings of statements led by ``local``, which may go on over lines on their own level."""
    led = (s.own >= 0) & (s.local[s.own] > 0)
    binds = np.flatnonzero(led & ~function & (s.at.opens == 0) & (s.at.closes == 0))
    starts = np.flatnonzero(s.is_start & (s.local > 0))
    key = lambda rows, n: x.group[rows] << 40 | n
    own = key(binds, s.own_n[binds])
    order = np.argsort(own, kind="stable")
    own, binds = own[order], binds[order]
    mine = key(starts, x.n[starts])
    first, last = np.searchsorted(own, mine), np.searchsorted(own, mine, side="right")
    out, known = {}, {}
    for row, a, b in zip(starts.tolist(), first.tolist(), last.tolist(), strict=True):
        text = x.texts[binds[a]] if b - a == 1 and not x.doubled else "\n".join(x.texts[i] for i in binds[a:b] if s.at.xl[i] == s.at.xl[row])
        if text not in known:
            known[text] = bindings(text)
        out[row] = known[text]
    return out


def _numbered_by_place(x: Lexemes, out: dict[str, list]) -> None:
    """Numbers for files with one id, whose elements may share a place: by the place in their list, kind and text."""
    nth, last = [], None
    for row in out["row"]:
        nth.append(nth[-1] + 1 if row == last else 0)
        last = row
    key = [(int(x.group[r]), int(x.n[r]), i, k, x.texts[r]) for r, i, k in zip(out["row"], nth, out["kind"], strict=True)]
    number, group = 0, -1
    for i in sorted(range(len(key)), key=key.__getitem__):
        number, group = (number + 1 if key[i][0] == group else 1), key[i][0]
        out["elem_no"][i] = number


def _elements(x: Lexemes) -> pa.RecordBatch:
    file = Window(None, x.group)
    at = places(x, file)
    s = statements(x, at, file)
    function = is_kind(s.at.k, "function")
    bound = _bound(x, s, function)
    closed, local_start = function & (s.closer_k >= 0), (s.own >= 0) & (s.local[s.own] > 0)
    first_words = np.fromiter((t.startswith(("type", "export")) for t in x.texts), bool, len(x.texts))
    prev_line, prev_col = file.lag(at.line, 0), file.lag(at.col, 0)

    # Kinds, and the functions that hide or hold what is inside.
    kinds: dict[int, tuple[str, list[str], list[str]]] = {}
    hides, holds = set(), set()
    for row in np.flatnonzero(function | (s.is_start & first_words)).tolist():
        text = x.texts[row]
        name = px.function_name(text) if function[row] else ""
        if name and s.prev_local[row] == 2:
            kinds[row] = ("local_function", [name], [f"local {px.header_text(text, int(x.sig_end[row]))}"])
        elif name and s.is_start[row]:
            kinds[row] = ("function", [name], [px.header_text(text, int(x.sig_end[row]))])
            if closed[row]:
                holds.add(row)
        elif s.is_start[row] and (found := _TYPE.search(text)):
            kinds[row] = ("type_alias", [found[1]], [f"{'export ' if text.startswith('export') else ''}type {found[1]}"])
        if closed[row] and local_start[row]:
            hides.add(row)
    for row, (names, assigned) in bound.items():
        if names and row not in kinds:
            kinds[row] = ("constant" if assigned else "variable", names, [f"local {n}" for n in names])

    # In file order, the functions around each row.
    listed = np.array(sorted(kinds.keys() | hides), np.int64)
    around = np.array([r for r in listed.tolist() if r in hides or r in holds], np.int64)
    src = np.concatenate([listed, around, around])
    e = np.repeat([0, 1, -1], [len(listed), len(around), len(around)])
    pos = np.concatenate([x.n[listed], x.n[around], s.closer_n[around]])
    order = sorted_by(x.group[src], pos, e)
    out: dict[str, list] = {c: [] for c in ("row", "elem_no", "kind", "name", "line", "col", "container", "signature")}
    group, hidden, number, path = -1, 0, 0, []
    for row, side in zip(src[order].tolist(), e[order].tolist(), strict=True):
        if x.group[row] != group:
            group, hidden, number, path, depth, opened = x.group[row], 0, 0, [], 0, {}
        if side:
            hidden += side if row in hides else 0
            if row in holds:
                depth += side
                if side > 0:
                    opened[depth] = kinds[row][1][0]
            continue
        if hidden or row not in kinds:
            continue
        kind, names, signatures = kinds[row]
        local = kind == "local_function"
        container = ".".join(opened[d] for d in range(1, depth + 1) if d in opened) if depth > 0 else None
        for name, signature in zip(names, signatures, strict=True):
            number += 1
            line, col = (prev_line[row], prev_col[row]) if local else (at.line[row], at.col[row])
            for column, value in zip(out.values(), (row, number, kind, name, line, col, container, signature), strict=True):
                column.append(value)
    if x.doubled:
        _numbered_by_place(x, out)
    index = pa.array(x.file[np.array(out.pop("row"), np.int64)].astype(np.int32))
    units = pa.DictionaryArray.from_arrays(index, pa.array(x.ids, pa.string())).dictionary_decode()
    types = {"elem_no": pa.int32(), "line": pa.int32(), "col": pa.int32()}
    return pa.RecordBatch.from_arrays([units, *(pa.array(v, types.get(c, pa.string())) for c, v in out.items())], names=["unit_id", *out])

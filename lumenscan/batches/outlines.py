"""Functions and steps of a batch of files: the passes of ``operators.outline`` over arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenscan.batches import patterns as px
from lumenscan.batches.levels import is_kind, statements
from lumenscan.batches.lexemes import KIND, Lexemes, ScanFacts, constants, cut, id_column, places
from lumenscan.batches.windows import Window, chosen, sorted_by

SCHEMA = (
    "unit_id string, fn_no int, fn_name string, step_no int, sub_end int, parent_no int, branch string, ordinal int, kind string, "
    "label string, condition string, header string, signature string, n_then int, n_else int, n_body int, line int, start int, stop int"
)
# Less than all numbers of rows.
_NONE = -(1 << 30)
_BLOCK, _SPLICE, _FN, _DROP = 1, 2, 3, 4
_STEP, _FUNCTION, _END, _ELSE, _OPEN = 1, 2, 3, 4, 5
_STEP_KINDS = ("function", "if", "while", "repeat_until", "numeric_for", "for_in", "closure", "action")
_CODE = {name: code for code, name in enumerate(_STEP_KINDS)}
_WHOLE = re.compile(rf"^[a-z]+\s*|\s*(?:then|do){px._END}", re.ASCII)
_UNTIL = px.java(r"^until\s*")
_SIGN = px.java(r"(=|(?<![A-Za-z0-9_])in(?![A-Za-z0-9_]))")


def outline_of(ids: list, contents: list, min_closure_chars: int) -> Iterator[pa.RecordBatch]:
    """``outline.outline`` of whole files."""
    x = cut(ids, contents, px.SCANNED, ScanFacts(), with_headers=True)
    if len(x.texts):
        yield from _outline(x, min_closure_chars)


def _outline(x: Lexemes, min_closure_chars: int) -> Iterator[pa.RecordBatch]:
    file = Window(None, x.group)
    s = statements(x, places(x, file), file)
    k, whole, n = s.at.k, s.at.whole, x.n
    function = is_kind(k, "function")

    # What a closed block is (``outline._roles``).
    closed = (s.at.opens == 1) & (s.closer_k >= 0)
    heads = s.in_head & (s.head_n == s.own_n) & (s.own >= 0)
    owns = np.where((whole == 1) | is_kind(k, "repeat"), s.is_start, is_kind(k, "then", "do") & heads)
    splice = is_kind(k, "do") & ~s.in_head
    role = np.where(closed, np.where(function, _FN, np.where(owns, _BLOCK, np.where(splice, _SPLICE, _DROP))), 0)
    body = s.body_end - (s.places.start + x.stop - x.begin)
    own_k = chosen(k, s.own, -1)
    deco = (
        function & (s.body_end >= 0) & (body >= min_closure_chars) & (s.own >= 0)
        & ~is_kind(own_k, "if", "elseif", "while", "for", "repeat") & ~s.in_head & ((s.fn_before < 0) | (s.fn_before < s.own_n))
    )
    names: dict[int, str] = {}
    sigs: dict[int, str] = {}
    for row in np.flatnonzero(function).tolist():
        text = x.raw(row)
        if s.closer_k[row] == KIND["end"] and (name := px.function_name(text)):
            names[row] = name
        header = px.header_text(text, int(x.sig_end[row]))
        sigs[row] = f"local {header}" if s.prev_local[row] == 2 and s.at.prev_nl[row] == 0 else header
    has_name = np.zeros(len(n), bool)
    has_name[list(names)] = True

    # Lexemes and block events (``outline._events``).
    keeps_text = (role == _DROP) | ((role == _FN) & ~deco)
    blocks = np.flatnonzero(role)
    src = np.concatenate([np.arange(len(n)), blocks, blocks])
    ev = np.repeat([0, 1, -1], [len(n), len(blocks), len(blocks)])
    at = np.concatenate([n * 4 + 1, n[blocks] * 4 + 2, s.closer_n[blocks] * 4 + np.where(keeps_text[blocks], 3, 0)])
    tie = None if s.rank is None else s.rank[src] * 3 + ev % 3
    order = sorted_by(x.group[src], at, tie=tie)
    src, ev, at = src[order], ev[order], at[order]
    group, role, deco, named, k_, n_ = x.group[src], role[src], deco[src], (has_name & (role == _FN))[src], k[src], n[src]
    closer_k, own_n, link = s.closer_k[src], s.own_n[src], s.link[src]

    # In file order: function, depth, step number and text owner (``outline._places``).
    to = Window(None, group)
    nested = to.total(np.where(named, ev, 0))
    top = named & (ev != 0) & (nested == (ev == 1))
    in_fn = nested > 0
    cont = (ev != 0) & in_fn & ((role == _BLOCK) | ((role == _FN) & deco & ~top))
    drops = in_fn & ((role == _DROP) | ((role == _FN) & ~deco & ~top))
    top_open = top & (ev == 1)
    fn_no = to.total(top_open) - 1
    newest_fn = to.newest(top_open)
    kept = to.total(np.where(drops, ev, 0)) == 0
    depth = to.total(np.where(cont, ev * (link + 1), 0))
    is_step = (ev == 0) & s.is_start[src] & in_fn & kept
    edge = (ev != 0) & (top | cont | (role == _SPLICE))
    is_else = (ev == 0) & is_kind(k_, "else")
    until = (ev == -1) & cont & kept & (closer_k == KIND["until"])
    sinks = np.where(is_step, n_, np.where(until, own_n, -1))
    some = is_step | (until & (s.own[src] >= 0)) | (~until & kept & (edge | is_else))
    sink = chosen(sinks, to.newest(some), -1)
    so_far = to.total(is_step)
    count = so_far - chosen(so_far, newest_fn, 0)

    whole_ = whole[src]
    keyword = is_step & (whole_ != 1) & is_kind(k_, "if", "elseif", "while", "for", "repeat")
    block_word = is_kind(k_, "end", "elseif", "else") | (role == _BLOCK) | (role == _SPLICE) | deco
    separator = is_kind(k_, ";") & s.at_base[src]
    hidden = keyword | (kept & ~(is_step & (whole_ == 1)) & (block_word | separator))
    is_text = (ev == 0) & (sink >= 0) & ~hidden

    # Along each depth the newest open event is the parent (``outline.outline``).
    inside = kept & in_fn
    link_end = cont & inside & (ev == -1) & (closer_k != KIND["elseif"])
    mark = np.select(
        [is_step, top_open, link_end, cont & inside & (ev == -1), cont & inside & (ev == 1), is_else & inside],
        [_STEP, _FUNCTION, _END, _ELSE, _OPEN, _ELSE], 0,
    )
    marked = np.flatnonzero(mark)
    times = np.where(mark[marked] == _END, link[marked] + 1, 1)
    m = np.repeat(marked, times)
    nth = np.arange(len(m)) - np.repeat(np.cumsum(times) - times, times)
    mk = mark[m]
    level = depth[m] + np.where(mk == _END, 1 + nth, 0)
    level += np.where((mk == _ELSE) & (ev[m] == -1), 1 + link[m], 0) + np.where((mk == _STEP) & is_kind(k_[m], "elseif"), link[m], 0)
    level = np.where(mk == _FUNCTION, -1, level)
    by_depth = sorted_by(group[m], fn_no[m], level)
    m, mk, level = m[by_depth], mk[by_depth], level[by_depth]
    along = Window(None, group[m], fn_no[m], level)
    forks = is_kind(k_[m], "then") | ((whole_[m] == 1) & is_kind(k_[m], "if", "elseif"))
    forks &= count[m] > 0
    opened = along.newest(mk == _OPEN)
    parts = (mk == _OPEN) | (mk == _ELSE)
    part_row = along.newest(parts, before=True)
    part, siblings = chosen(mk, part_row, 0), along.total(mk == _STEP)
    in_part = siblings - chosen(siblings, part_row, 0)
    parent_n = chosen(own_n[m], opened, -1)

    # Per step, what other rows say about it (``outline._gathered``).
    counted = (mk == _ELSE) | (mk == _END)
    key = np.select([(mk == _FUNCTION) | (mk == _STEP), mk == _OPEN], [n_[m], own_n[m]], parent_n)
    keys, where = np.unique(group[m] << 40 | (key + 1), return_inverse=True)

    def most(values: np.ndarray, when: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NONE)
        np.maximum.at(out, where[when], values[when])
        return out[where]

    n_first, n_other = most(in_part, counted & (part == _OPEN)), most(in_part, counted & (part == _ELSE))
    sub_end = most(count[m] - 1, mk == _END)
    closures: dict[int, str] = {}
    for row in np.flatnonzero((mk == _OPEN) & is_kind(k_[m], "function")).tolist():
        sig = sigs[int(src[m[row]])]
        closures[int(where[row])] = max(closures.get(int(where[row]), sig), sig)
    final = np.flatnonzero((mk == _STEP) | (mk == _FUNCTION))
    final = final[sorted_by(group[m[final]], n_[m[final]], at[m[final]])]  # as they stand in the file
    step = mk[final] == _STEP
    rows, whose = src[m[final]], where[final]
    depth_of = np.where(mark == _STEP, depth + np.where(is_kind(k_, "elseif"), link, 0), -1)
    pieces = np.flatnonzero(is_text)
    if x.doubled:  # lexemes of files with one id may have one place
        pieces = pieces[np.lexsort((pieces, depth_of[pieces], fn_no[pieces], at[pieces], group[pieces]))]
    txt = _texts(x, src[pieces], group[pieces] << 40 | (sink[pieces] + 1), keys[whose], whole[rows], k[rows])
    yield _described(
        x, s, rows, step, fn_no[m[final]], [names[int(r)] for r in src[np.maximum(newest_fn[m[final]], 0)]],
        count[m[final]] - 1, sub_end[final], chosen(count[m] - 1, opened, _NONE)[final], chosen(forks.astype(np.int64), opened, -1)[final],
        part[final], in_part[final], n_first[final], n_other[final], txt, [closures.get(w) for w in whose.tolist()],
        [sigs.get(r) for r in rows.tolist()],
    )


def _texts(x: Lexemes, rows, own, keys, whole, k) -> list[str]:
    """The text of each step by its key: the lexemes that it owns put together, without what its label does not show."""
    order = np.argsort(own, kind="stable")
    own, rows = own[order], rows[order]
    first, last = np.searchsorted(own, keys), np.searchsorted(own, keys, side="right")
    begin, end, stop = x.begin[rows], x.end[rows], x.stop[rows]
    # A text without gaps is cut out of the file as a whole.
    gaps = np.zeros(len(rows) + 1, np.int64)
    gaps[1:-1] = np.cumsum(begin[1:] != stop[:-1]) if len(rows) else 0
    begin, end, stop, gaps = begin.tolist(), end.tolist(), stop.tolist(), gaps.tolist()
    out, joined = [], x.joined
    known: dict[tuple, str] = {}
    for a, b, w, kind in zip(first.tolist(), last.tolist(), whole.tolist(), k.tolist(), strict=True):
        if a == b:
            out.append("")
            continue
        if b - a == 1 or gaps[b - 1] == gaps[a]:
            text = joined[begin[a] : end[b - 1]]
        else:
            text = "".join(joined[begin[i] : stop[i]] for i in range(a, b - 1)) + joined[begin[b - 1] : end[b - 1]]
        bare = (text, w == 1, kind == KIND["repeat"])
        if (shown := known.get(bare)) is None:
            shown = _WHOLE.sub("", text) if w == 1 else _UNTIL.sub("", text) if bare[2] else text
            known[bare] = shown = px.compact(shown)
        out.append(shown)
    return out


def _described(x, s, rows, step, fn_no, fn_name, step_no, sub_end, parent, forks, part, in_part, n_first, n_other, txt, closure, sig):
    """``outline._described``: kinds, labels and counts by their public names."""
    k = s.at.k[rows]
    kind = np.full(len(rows), _CODE["action"])
    kind[[c is not None for c in closure]] = _CODE["closure"]
    for_ = is_kind(k, "for") & step
    kind[for_] = _CODE["for_in"]
    for row in np.flatnonzero(for_).tolist():
        if (sign := _SIGN.search(txt[row])) and sign[1] == "=":
            kind[row] = _CODE["numeric_for"]
    kind[is_kind(k, "repeat")] = _CODE["repeat_until"]
    kind[is_kind(k, "while")] = _CODE["while"]
    kind[is_kind(k, "if", "elseif")] = _CODE["if"]
    kind[~step] = _CODE["function"]
    of = lambda *names: np.isin(kind, [_CODE[n] for n in names])
    texts = pa.array(txt, pa.string())
    null = pa.scalar(None, pa.string())
    action, is_closure, is_if = of("action"), of("closure"), of("if")
    closure_text = pa.array([px.compact_ends(f"{t} {{...}}") if c else None for t, c in zip(txt, is_closure.tolist())], pa.string())
    label = pc.if_else(pa.array(action), texts, closure_text)
    or_word = pc.if_else(pc.equal(texts, ""), "condition", texts)
    signature = pa.array([c if is_c else g if f else None for c, g, is_c, f in zip(closure, sig, is_closure.tolist(), (~step).tolist())], pa.string())
    branch = np.select([forks == 0, part == _OPEN, part == _ELSE], [0, 1, 2], 0)
    int32 = lambda v, null=None: pa.array(v.astype(np.int32), mask=null)
    no_body = is_if | of("action", "function")
    return pa.RecordBatch.from_arrays(
        [
            id_column(x, rows), int32(fn_no), pa.array(fn_name, pa.string()), int32(step_no, ~step),
            int32(np.where(sub_end > _NONE, sub_end, step_no), ~step), int32(parent, ~step | (parent == _NONE)),
            constants(np.where(step, branch, -1), ["body", "then", "else"]), int32(in_part - 1, ~step), constants(kind, list(_STEP_KINDS)),
            label, pc.if_else(pa.array(of("if", "while", "repeat_until")), or_word, null),
            pc.if_else(pa.array(of("for_in", "numeric_for")), texts, null), signature,
            int32(np.where(is_if, np.maximum(n_first, 0), 0)), int32(np.where(is_if, np.maximum(n_other, 0), 0)),
            int32(np.where(no_body, 0, np.maximum(n_first, 0))),
            int32(s.places.line[rows]), int32(s.places.start[rows]), int32(s.stop[rows], s.stop[rows] < 0),
        ],
        names=["unit_id", "fn_no", "fn_name", "step_no", "sub_end", "parent_no", "branch", "ordinal", "kind", "label", "condition",
               "header", "signature", "n_then", "n_else", "n_body", "line", "start", "stop"],
    )

"""The rules that look at one step, over arrays of whole functions: ``operators.context`` and the step rules.

What a rule reads off a label alone is looked up once for a label of a batch, as *candidates*: the rule, where it
applies (always, in a loop, in a handler ...), and its message on both sides of the function's name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenscan.batches import patterns as px
from lumenscan.batches.windows import Window, chosen, sorted_by
from lumenscan.functions.labels import TERMINATORS
from lumenscan.operators.context import CRITICAL_HANDLER, FRAME_SIGNAL, LOOPS

COLUMNS = (
    "unit_id", "fn_no", "fn_name", "step_no", "sub_end", "parent_no", "branch", "ordinal", "kind", "label", "condition", "header",
    "n_then", "n_body", "line",
)
# What each rule reads besides; the others' columns are left out of the shuffle.
_ROW = ("unit_id", "fn_no", "fn_name", "step_no", "kind", "line")
_PLACE = ("parent_no", "branch", "ordinal")
READS = {
    "empty-function": (), "long-function": (), "connect-leak": ("label",), "unreachable": ("label", "sub_end", *_PLACE),
    "deep-nesting": ("sub_end",), "infinite-loop": ("label", "condition", "sub_end"), "empty-then": ("condition", "n_then"),
    "duplicate-condition": ("condition", *_PLACE), "identical-actions": ("label", *_PLACE), "nested-loops": ("sub_end",),
    "empty-loop": ("condition", "header", "n_body"), "redundant-condition": ("condition",), "complex-condition": ("condition",),
    "unprotected-remote": ("label", "condition", "sub_end"),
    **dict.fromkeys(("deprecated-api", "self-assignment", "magic-numbers", "global-variable", "pcall-ignored-result",
                     "infinite-yield-risk", "unsafe-tonumber"), ("label",)),
    **dict.fromkeys(("wait-in-loop", "nested-closures", "instance-in-loop", "getchildren-in-loop", "yield-in-critical", "remote-spam",
                     "task-spawn-storm", "require-in-loop", "event-reconnect-loop"), ("label", "sub_end")),
}


def reads(wanted: frozenset[str]) -> set[str]:
    return {*_ROW, *(column for rule in wanted for column in READS[rule])}


# Words that show clean-up (fixed values).
CLEANUP_MARKERS = ("Maid", "Janitor", "Trove", ":Disconnect()")
# Steps of a batch; a function is never divided.
BATCH_STEPS = 1 << 16

ALWAYS, IN_LOOP, IN_HANDLER, IN_FRAME, UNCHECKED = range(5)
_KINDS = ("action", "closure", "if", *LOOPS)
_KIND = {name: code for code, name in enumerate(_KINDS)}
_LOOP_CLASSES = {"while": "WhileFlowStep", "for_in": "ForInFlowStep", "numeric_for": "NumericForFlowStep", "repeat_until": "RepeatUntilFlowStep"}
_NULL = -(1 << 40)

_DOT = r"[^\n\r\u0085\u2028\u2029]"
_BEFORE = r"(?<![A-Za-z0-9_])"
_FIRST_WORD = px.java(r"^\s*([^\s(]*)")
_CRITICAL, _FRAME = px.java(CRITICAL_HANDLER), px.java(FRAME_SIGNAL)
_ASSIGN = px.java(r"^([A-Za-z0-9_.:\[\]]+)\s*=\s*([A-Za-z0-9_.:\[\]]+)\s*$")
_INLINE = px.java(r"function ?\(")
_CONSTANT = px.java(r"^local\s+[A-Z_][A-Z0-9_]*\s*=")
_NUMBERS = [px.java(lead + rf"(\d+(?:\.\d+)?)\s*(?:--{_DOT}*)?$") for lead in (r"[+\-*/]=\s*", r"\.[A-Za-z0-9_]+\s*=\s*")]
_GLOBAL, _CHILDREN = px.java(r"_G\s*[.\[]"), px.java(r":Get(?:Children|Descendants)\(\)")
_TO_SERVER, _YIELDS = px.java(r":(?:Fire|Invoke)Server\("), px.java(r"(?:task\.)?wait\s*\(")
_PCALL, _SPACED_PCALL = px.java(rf"{_BEFORE}x?pcall\s*\("), px.java(rf"^({_DOT}*?){_BEFORE}x?pcall\s*\(")
_WAIT_FOR_CHILD = px.java(r""":WaitForChild\(\s*["'][^"']*["']\s*\)""")
_SENDS, _SPAWNS = px.java(r":(?:FireServer|FireAllClients|FireClient)\s*\("), px.java(r"task\.spawn\s*\(|coroutine\.wrap\s*\(")
_TO_NUMBER, _TO_NUMBER_OR = px.java(rf"{_BEFORE}tonumber\s*\([^)]+\)"), px.java(rf"{_BEFORE}tonumber\s*\([^)]+\)\s+or\s+")


def first_word(label: str) -> str:
    return _FIRST_WORD.match(label)[1]


def has_type_check(text: str) -> bool:
    return "type(" in text or "typeof(" in text


def _magic(number: str) -> str:
    """The number as written, without idle zeros."""
    whole = re.sub(r"\.0+\Z", "", number)
    return re.sub(r"^0+(?=\d)", "", whole.rstrip("0") if "." in whole else whole)


class Label:
    """What a label says alone."""

    __slots__ = ("candidates", "trimmed", "word", "checks", "critical", "frame", "connects", "cleans")

    def __init__(self, label: str, closure: bool):
        self.trimmed, self.word, self.checks = px.strip(label), first_word(label), has_type_check(label)
        self.critical, self.frame = _CRITICAL.search(label) is not None, _FRAME.search(label) is not None
        self.connects, self.cleans = ":Connect(" in label, any(m in label for m in CLEANUP_MARKERS)
        self.candidates = [*(_closure_candidates if closure else _action_candidates)(label, self.trimmed)]


_FN = " in function '"
Candidate = tuple[str, int, str, str]


def _of_both(label: str, trimmed: str, l60: str) -> Iterator[Candidate]:
    if _PCALL.search(trimmed):
        at = trimmed.find("pcall(")
        spaced = _SPACED_PCALL.match(trimmed) if at < 0 else None
        before = trimmed[:at] if at >= 0 else spaced[1] if spaced else ""
        if "=" not in before:
            yield "pcall-ignored-result", ALWAYS, f"pcall/xpcall result ignored{_FN}", f"': errors silently swallowed — {l60}"
    if _SPAWNS.search(label):
        yield "task-spawn-storm", IN_LOOP, f"task.spawn/coroutine.wrap inside loop{_FN}", f"': scheduler overload, batch or queue instead — {l60}"
    if ":Connect(" in label:
        yield "event-reconnect-loop", IN_LOOP, f":Connect() inside loop{_FN}", "': creates new connection every iteration, leaks memory"


_UNTYPED = f"Remote handler{_FN}", "' has no type validation — exploiters can send any data"


def _closure_candidates(label: str, trimmed: str) -> Iterator[Candidate]:
    if "OnServerEvent" in label or "OnServerInvoke" in label:
        yield "unprotected-remote", UNCHECKED, *_UNTYPED
    yield from _of_both(label, trimmed, trimmed[:60])


def _action_candidates(label: str, trimmed: str) -> Iterator[Candidate]:
    l60, low = trimmed[:60], label.lower()
    for call in ("spawn(", "delay(", "wait("):
        if (at := label.find(call)) >= 0 and "task." not in label[:at] and "coroutine." not in label[:at]:
            yield "deprecated-api", ALWAYS, f"Deprecated API '{call}(...)'{_FN}", f"': use task.{call}() instead"
    if "wait(" in low or "wait (" in low:
        yield "wait-in-loop", IN_LOOP, f"wait() inside loop{_FN}", f"' hurts performance: {trimmed}"
    if (sides := _ASSIGN.match(trimmed)) and sides[1] == sides[2]:
        yield "self-assignment", ALWAYS, f"Self-assignment{_FN}", f"': {l60} — variable assigns to itself"
    if (inline := len(_INLINE.findall(label))) > 1:
        yield "nested-closures", ALWAYS, f"{inline} nested closures{_FN}", _CALLBACKS
    if not _CONSTANT.match(trimmed):
        for pattern in _NUMBERS:
            if (found := pattern.search(trimmed)) and float(found[1]) > 1:
                yield (
                    "magic-numbers", ALWAYS, f"Magic number {_magic(found[1])}{_FN}",
                    f"': extract to a named constant in Shared/Balance — {l60}",
                )
    if _GLOBAL.search(label):
        yield "global-variable", ALWAYS, f"_G usage{_FN}", f"': never use global state in production Roblox code — {l60}"
    if "Instance.new(" in label:
        yield "instance-in-loop", IN_LOOP, f"Instance.new() inside loop{_FN}", f"': use object pooling to avoid GC pressure — {l60}"
    if _CHILDREN.search(label):
        yield "getchildren-in-loop", IN_LOOP, f":GetChildren() inside loop{_FN}", "': cache the result outside the loop"
    if _TO_SERVER.search(trimmed):
        yield "unprotected-remote", ALWAYS, f"Remote call{_FN}", f"': ensure server validates all parameters — {l60}"
    if _CRITICAL.search(trimmed) and not has_type_check(trimmed):
        yield "unprotected-remote", ALWAYS, *_UNTYPED
    if _YIELDS.search(label):
        blocks = f"Yield inside critical handler{_FN}", f"': blocks the thread and creates race conditions — {l60}"
        if _CRITICAL.search(label):
            yield "yield-in-critical", ALWAYS, *blocks
        yield "yield-in-critical", IN_HANDLER, *blocks
    if _WAIT_FOR_CHILD.search(label):
        yield (
            "infinite-yield-risk", ALWAYS, f":WaitForChild() without timeout{_FN}",
            f"': can hang forever — add a timeout parameter — {l60}",
        )
    if _SENDS.search(label):
        yield "remote-spam", IN_LOOP, f"Remote :Fire*() inside loop{_FN}", f"': rate-limited by Roblox, add debounce — {l60}"
        yield "remote-spam", IN_FRAME, f"Remote :Fire*() inside frame signal handler{_FN}", f"': fires every frame, add throttle — {l60}"
    if "require(" in label:
        yield "require-in-loop", IN_LOOP, f"require() inside loop{_FN}", f"': move outside the loop — {l60}"
    if _TO_NUMBER.search(trimmed) and not _TO_NUMBER_OR.search(trimmed):
        yield "unsafe-tonumber", ALWAYS, f"tonumber() without nil check{_FN}", "': add fallback like tonumber(x) or 0"
    yield from _of_both(label, trimmed, l60)


_CALLBACKS = "' — callback hell, refactor with named functions"


def _ints(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def _codes(column: pa.ChunkedArray, names: list[str]) -> np.ndarray:
    """Places of values among ``names``, or -1."""
    return pc.fill_null(pc.index_in(column, pa.array(names)), -1).to_numpy().astype(np.int64)


def _function_keys(steps: pa.Table) -> np.ndarray:
    """Numbers of the functions that the rows, which are sorted by them, belong to."""
    units = steps["unit_id"].combine_chunks().dictionary_encode()
    units = pc.fill_null(units.indices, -1).to_numpy(zero_copy_only=False)
    fns = _ints(steps["fn_no"], _NULL)
    new = np.ones(len(fns), bool)
    new[1:] = (units[1:] != units[:-1]) | (fns[1:] != fns[:-1])
    return np.cumsum(new)


def whole_functions(batches: Iterator[pa.RecordBatch], limit: int = BATCH_STEPS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole functions, ``limit`` steps or so each, with the number of each row's function."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, limit
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held)
            keys = _function_keys(table)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut), keys[:cut]
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
            # A function larger than that is looked at again when it has doubled.
            enough = max(limit, 2 * size)
    if size:
        table = pa.Table.from_batches(held)
        yield table, _function_keys(table)


class Labels:
    """The labels of rows, each different one looked at once; ``at`` is the row's one, or -1."""

    def __init__(self, column: pa.ChunkedArray, closure: np.ndarray):
        found = column.combine_chunks().dictionary_encode()
        texts, codes = found.dictionary.to_pylist(), pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
        both, at = np.unique(np.where(codes < 0, -1, codes.astype(np.int64) * 2 + closure), return_inverse=True)
        none = int(len(both) > 0 and both[0] < 0)
        self.all = [Label(texts[c >> 1], bool(c & 1)) for c in both[none:].tolist()]
        self.at = at - none
        numbers: dict[str, int] = {}
        self.trimmed = self.of(lambda x: numbers.setdefault(x.trimmed, len(numbers)) if x.trimmed else -1, -1)

    def of(self, what: Callable[[Label], int], otherwise: int = 0) -> np.ndarray:
        values = np.fromiter((what(x) for x in self.all), np.int64, len(self.all))
        return chosen(values, self.at, otherwise)

    def flag(self, what: Callable[[Label], bool]) -> np.ndarray:
        return self.of(what) > 0


class Context:
    """The columns of ``context.with_siblings`` and ``with_context`` that the rules read, in the rows' order."""

    def __init__(self, fn: np.ndarray, steps: pa.Table, kind: np.ndarray, labels: Labels):
        step_no, sub_end = _ints(steps["step_no"], _NULL), _ints(steps["sub_end"], _NULL)
        flag = labels.flag
        action = kind == _KIND["action"]

        # Siblings: the sequence a step stands in, as one number; a parent's parts follow each other.
        part = _codes(steps["branch"], ["then", "else"])
        part = np.where(part < 0, 2, part)
        seq = (_ints(steps["parent_no"], -1) + 1) * 3 + part
        order = sorted_by(fn, seq, _ints(steps["ordinal"], _NULL))
        sequence = Window(order, fn, seq)
        dead = sequence.newest(action & flag(lambda x: x.word in TERMINATORS), before=True) >= 0
        self.previous = sequence.lag(np.arange(len(seq)), -1)
        self.first_dead = dead & ~((self.previous >= 0) & dead[self.previous])

        # Every container also has a close row at ``sub_end``; read backwards, it enters the container.
        containers = order[kind[order] > _KIND["action"]]
        rows = np.concatenate([order, containers])
        is_row = np.repeat([1, 0], [len(order), len(containers)])
        pos = np.where(is_row == 1, step_no[rows], sub_end[rows])
        place = sorted_by(fn[rows], -pos, is_row, step_no[rows])
        rows, is_row = rows[place], is_row[place]
        run = Window(None, fn[rows])
        k, own = kind[rows], is_row == 1
        enters = np.where(k > _KIND["action"], 1 - 2 * is_row, 0)

        def back(values: np.ndarray) -> np.ndarray:
            out = np.empty(len(order), values.dtype)
            out[rows[own]] = values[own]
            return out

        def ancestors(which: np.ndarray) -> np.ndarray:
            return back(run.total(np.where(which[rows], enters, 0)))

        def reaches(which: np.ndarray) -> np.ndarray:
            newest = run.newest(own & which[rows], before=True)
            return back((newest >= 0) & (chosen(step_no[rows], newest, 0) <= sub_end[rows]))

        closure, is_if = kind == _KIND["closure"], kind == _KIND["if"]
        checked = pc.fill_null(pc.or_(*(pc.match_substring(steps["condition"], c) for c in ("type(", "typeof("))), False)
        checked = checked.to_numpy()
        self.loop_depth, self.if_depth, self.closure_depth = ancestors(kind > _KIND["if"]), ancestors(is_if), ancestors(closure)
        self.dead_depth = ancestors(dead)
        self.critical_depth = ancestors(closure & flag(lambda x: x.critical))
        self.frame_depth = ancestors(closure & flag(lambda x: x.frame))
        self.has_exit = reaches(action & flag(lambda x: x.word in ("break", "return")))
        self.has_check = reaches((action & flag(lambda x: x.checks)) | (is_if & checked))


def _of_functions(steps: pa.Table, fn: np.ndarray, kind: np.ndarray, labels: Labels, most: int, hit: Callable) -> None:
    """The rules about whole functions, at their own rows; a function without a file or number has no steps."""
    functions = np.flatnonzero(_codes(steps["kind"], ["function"]) == 0)
    if not len(functions):
        return
    place = fn - fn[0]
    of = lambda flags: np.bincount(place, weights=flags, minlength=int(place[-1]) + 1).astype(np.int64)
    is_step = np.ones(len(fn), bool)
    is_step[functions] = False
    called = (kind == _KIND["action"]) | (kind == _KIND["closure"])
    known = (pc.is_valid(steps["unit_id"]).to_numpy() & pc.is_valid(steps["fn_no"]).to_numpy())[functions]
    n_steps = np.where(known, of(is_step)[place[functions]], 0)
    connects, cleans = (known & (of(called & labels.flag(f))[place[functions]] > 0) for f in (lambda x: x.connects, lambda x: x.cleans))
    for row, n, connect, clean in zip(functions.tolist(), n_steps.tolist(), connects.tolist(), cleans.tolist(), strict=True):
        if n == 0:
            hit(row, "empty-function", "Function '", "' has an empty body")
        if n > most:
            hit(row, "long-function", "Function '", f"' has {n} steps (exceeds {most})")
        if connect and not clean:
            hit(row, "connect-leak", f":Connect(){_FN[:-1]}'", "' without cleanup — use Maid/Janitor/Trove to prevent memory leaks")


def findings_of(
    steps: pa.Table, fn: np.ndarray, wanted: frozenset[str], max_nesting_depth: int, max_function_steps: int
) -> tuple[list[int], list[str], list[str | None]]:
    """Of whole functions the rows with findings, their rules and their messages."""
    kind = _codes(steps["kind"], list(_KINDS))
    labels = Labels(steps["label"], kind == _KIND["closure"])
    c = Context(fn, steps, kind, labels)
    names, conditions, headers = (steps[x].to_pylist() for x in ("fn_name", "condition", "header"))
    n_then, n_body = _ints(steps["n_then"], -1).tolist(), _ints(steps["n_body"], -1).tolist()
    previous, loops, ifs, closures = c.previous.tolist(), c.loop_depth.tolist(), c.if_depth.tolist(), c.closure_depth.tolist()
    handlers, frames, checks, exits = c.critical_depth.tolist(), c.frame_depth.tolist(), c.has_check.tolist(), c.has_exit.tolist()
    unreachable = c.first_dead & (c.dead_depth == 0)
    rows: list[int] = []
    rules: list[str] = []
    messages: list[str | None] = []
    action, before_it = kind == _KIND["action"], np.maximum(c.previous, 0)
    same = action & (c.previous >= 0) & action[before_it] & (labels.trimmed >= 0) & (labels.trimmed == labels.trimmed[before_it])
    # Most steps are actions of which no rule says anything.
    some = labels.flag(lambda x: bool(x.candidates)) & (action | (kind == _KIND["closure"]))
    some |= same | (kind > 0) | unreachable
    same, unreachable, kinds, label_of = same.tolist(), unreachable.tolist(), steps["kind"].to_pylist(), labels.at.tolist()
    labels_ = [labels.all[i] if i >= 0 else None for i in label_of]

    def hit(row: int, rule: str, before: str | None, after: str | None, times: int = 1) -> None:
        if rule in wanted:
            f = names[row]
            message = None if f is None or before is None or after is None else f"{before}{f}{after}"
            rows.extend([row] * times)
            rules.extend([rule] * times)
            messages.extend([message] * times)

    _of_functions(steps, fn, kind, labels, max_function_steps, hit)
    for row in np.flatnonzero(some).tolist():
        k, label, last = kinds[row], labels_[row], previous[row]
        if unreachable[row]:
            word = labels_[last].word if last >= 0 and labels_[last] is not None else None
            what = label.trimmed[:60] if k == "action" and label is not None and label.trimmed else "..."
            hit(row, "unreachable", None if word is None else f"Unreachable code after '{word}'{_FN}", f"': {what}")
        if k == "action" or k == "closure":
            if k == "closure":
                if closures[row] > 0:
                    hit(row, "nested-closures", f"{closures[row] + 1} nested closures{_FN}", _CALLBACKS)
            elif same[row]:
                hit(row, "identical-actions", f"Duplicated action{_FN}", f"': {label.trimmed[:60]}")
            for rule, where, before, after in label.candidates if label is not None else ():
                if where == ALWAYS or (where == IN_LOOP and loops[row] > 0) or (where == UNCHECKED and not checks[row]):
                    hit(row, rule, before, after)
                elif where == IN_HANDLER and handlers[row] > 0:
                    hit(row, rule, before, after, handlers[row])
                elif where == IN_FRAME and frames[row] > 0:
                    hit(row, rule, before, after, frames[row])
            continue
        condition = conditions[row]
        cond = None if condition is None else px.strip(condition)
        low = None if cond is None else cond.lower()
        if k == "if":
            if ifs[row] + 1 > max_nesting_depth:
                hit(row, "deep-nesting", f"Nested {ifs[row] + 1} levels deep{_FN}", f"' (max {max_nesting_depth})")
            if n_then[row] == 0:
                hit(row, "empty-then", f"Empty 'then' branch{_FN}", None if condition is None else f"' for condition: {condition}")
            if condition is None:
                continue
            if last >= 0 and kinds[last] == "if" and conditions[last] is not None and px.strip(conditions[last]) == cond:
                hit(row, "duplicate-condition", f"Duplicate condition '{cond}'{_FN}", "' — likely a copy-paste error")
            if low in ("true", "false"):
                hit(row, "redundant-condition", f"Hard-coded '{cond}' condition{_FN}", "' — dead code or debug leftover")
            if len(condition) > 80:
                hit(row, "complex-condition", f"Complex condition ({len(condition)} chars){_FN}", "' — extract to a named variable")
        elif k in _LOOP_CLASSES:
            if k == "while" and low == "true" and not exits[row]:
                hit(row, "infinite-loop", f"'while true' without break/return{_FN}", "'")
            if k == "repeat_until" and low == "false" and not exits[row]:
                hit(row, "infinite-loop", f"'repeat ... until false' without break/return{_FN}", "'")
            if loops[row] + 1 > 2:
                n = loops[row] + 1
                hit(row, "nested-loops", f"{n} nested loops{_FN}", f"' — O(n^{n}) complexity, risky in frame-tight code")
            if n_body[row] == 0:
                head = px.strip(headers[row] or condition or "")[:40]
                hit(row, "empty-loop", f"Empty loop body{_FN}", f"': {_LOOP_CLASSES[k]} ({head})")
            if k == "while" and low == "false":
                hit(row, "redundant-condition", f"'while false'{_FN}", "' — loop never executes")
    return rows, rules, messages


def finder(wanted: frozenset[str], max_nesting_depth: int, max_function_steps: int, numbers: dict[str, tuple[int, str]]) -> Callable:
    """An Arrow function from steps and rows of functions, sorted by function, to findings of the rules ``wanted``; ``numbers`` gives number and severity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for steps, fn in whole_functions(batches):
            rows, rules, messages = findings_of(steps, fn, wanted, max_nesting_depth, max_function_steps)
            at = pa.array(rows, pa.int64())
            taken = [steps[c].take(at).combine_chunks() for c in ("unit_id", "fn_no", "fn_name", "step_no", "line")]
            unit, fn_no, fn_name, step_no, line = taken
            of = [numbers[r] for r in rules]
            yield pa.RecordBatch.from_arrays(
                [
                    unit, fn_no, fn_name, pa.array([n for n, _ in of], pa.int32()), pa.array(rules, pa.string()),
                    pa.array([s for _, s in of], pa.string()), pa.array(messages, pa.string()), step_no.cast(pa.int32()), line,
                ],
                names=["unit_id", "fn_no", "fn_name", "rule_no", "rule", "severity", "message", "step_no", "line"],
            )

    return run

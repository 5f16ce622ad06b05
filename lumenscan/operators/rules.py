"""The thirty rules, and those a caller adds.

A rule is a number, a name, a severity and one or more *arms*, each a predicate and the
message it yields.  The thirty's arms over one step run in one pass over whole functions
(``batches.findings``).  A caller's ``Rule`` is data: it is checked against the columns it may
read, and runs over the steps with their context.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.batches import findings as batch
from lumenscan.functions.labels import strip
from lumenscan.operators import context as cx

ERROR, WARNING, INFO = "error", "warning", "info"

# Number, name and severity (fixed values, in the order findings are listed).
RULES = (
    (1, "empty-function", INFO),
    (2, "long-function", WARNING),
    (3, "unreachable", ERROR),
    (4, "deep-nesting", WARNING),
    (5, "deprecated-api", WARNING),
    (6, "infinite-loop", WARNING),
    (7, "empty-then", WARNING),
    (8, "wait-in-loop", WARNING),
    (9, "duplicate-condition", WARNING),
    (10, "identical-actions", WARNING),
    (11, "nested-loops", WARNING),
    (12, "self-assignment", ERROR),
    (13, "empty-loop", WARNING),
    (14, "redundant-condition", WARNING),
    (15, "complex-condition", INFO),
    (16, "nested-closures", WARNING),
    (17, "magic-numbers", INFO),
    (18, "global-variable", ERROR),
    (19, "instance-in-loop", WARNING),
    (20, "getchildren-in-loop", WARNING),
    (21, "unprotected-remote", ERROR),
    (22, "connect-leak", WARNING),
    (23, "yield-in-critical", ERROR),
    (24, "pcall-ignored-result", WARNING),
    (25, "infinite-yield-risk", WARNING),
    (26, "remote-spam", WARNING),
    (27, "task-spawn-storm", WARNING),
    (28, "require-in-loop", WARNING),
    (29, "event-reconnect-loop", WARNING),
    (30, "unsafe-tonumber", INFO),
)
RULE_NAMES = tuple(name for _, name, _ in RULES)
FUNCTION_RULES = ("empty-function", "long-function", "connect-leak")


@dataclass(frozen=True)
class Arm:
    """One way a rule applies to a step; ``times`` lets it apply more than once."""

    rule: str
    when: Column
    message: Column
    times: Column | None = None


@dataclass(frozen=True)
class Rule:
    """A rule of the caller's.

    ``when`` reads a step with its context and siblings (``kind``, ``label``, ``condition``,
    ``in_loop``, ``if_depth``, ``has_exit``, ``prev_label`` ...), or, if ``whole_function``, a
    function with ``n_steps``, ``connects`` and ``cleans``.  Places such as ``{label}`` in
    ``message`` are columns of the same row, ``{f}`` is the function name; a null is shown as
    nothing.  A predicate that is null does not hold.
    """

    no: int
    name: str
    severity: str
    when: Column
    message: str
    whole_function: bool = False

    def arm(self) -> Arm:
        parts = {name: F.coalesce(F.col("fn_name" if name == "f" else name).cast("string"), F.lit("")) for name in re.findall(r"\{(\w+)\}", self.message)}
        return Arm(self.name, self.when, text(self.message, **parts) if self.message else F.lit(""))


def _checked(extra: Iterable[Rule]) -> list[Rule]:
    """``extra``, if its numbers and names are new and its severities known."""
    numbers, names = {no for no, _, _ in RULES}, set(RULE_NAMES)
    extra = list(extra)
    for rule in extra:
        if rule.no in numbers or rule.name in names:
            raise ValueError(f"rule {rule.no} '{rule.name}' is there already")
        if rule.severity not in (ERROR, WARNING, INFO):
            raise ValueError(f"rule '{rule.name}': unknown severity '{rule.severity}'")
        numbers.add(rule.no)
        names.add(rule.name)
    return extra


def _arms_of(rows: DataFrame, extra: list[Rule]) -> list[Arm]:
    """Arms of ``extra`` over ``rows``, whose schema must have what they read."""
    arms = []
    for rule in extra:
        try:
            kinds = rows.select(rule.when.alias("when"), rule.arm().message.alias("message")).dtypes
        except AnalysisException as error:
            raise ValueError(f"rule '{rule.name}' cannot be read from its rows: {error}") from error
        if kinds[0][1] != "boolean":
            raise ValueError(f"rule '{rule.name}': its predicate is {kinds[0][1]}, not boolean")
        arms.append(rule.arm())
    return arms


def text(template: str, **parts: Column) -> Column:
    """A message from a template with ``{name}`` places; ``{f}`` is the function name."""
    parts = {"f": F.col("fn_name"), **parts}
    pieces: list[Column] = []
    rest = template
    while rest:
        head, opened, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not opened:
            break
        name, _, rest = tail.partition("}")
        pieces.append(parts[name].cast("string"))
    return F.concat(*pieces)


def _hits(rows: DataFrame, arms: list[Arm], step_no: Column, extra: list[Rule]) -> DataFrame:
    """One finding per satisfied arm.

    The arms form one array that a lambda filters.  Spark evaluates it expression by
    expression; as one generated method, dozens of patterns and messages would be too
    large for the JIT compiler.  Messages are built for satisfied arms only.
    """
    which = {name: (no, severity) for no, name, severity in RULES}
    which |= {rule.name: (rule.no, rule.severity) for rule in extra}
    hits = []
    for a in arms:
        no, severity = which[a.rule]
        hit = F.struct(
            F.lit(no).alias("rule_no"),
            F.lit(a.rule).alias("rule"),
            F.lit(severity).alias("severity"),
            a.message.alias("message"),
            (F.lit(1) if a.times is None else a.times).alias("times"),
        )
        hits.append(F.when(a.when, hit))
    found = rows.select(
        "unit_id", "fn_no", "fn_name", step_no.cast("int").alias("step_no"), "line",
        F.inline(F.filter(F.array(*hits), lambda hit: hit.isNotNull())),
    )
    return found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(
        "unit_id", "fn_no", "fn_name", "rule_no", "rule", "severity", "message", "step_no", "line"
    )


def _of_all(
    steps: DataFrame, functions: DataFrame | None, wanted: frozenset[str], max_nesting_depth: int, max_function_steps: int
) -> DataFrame:
    """Findings of the thirty: one shuffle of the steps by function, and one pass over whole functions.

    ``functions``, which the rules about whole functions need, come as rows among the steps.
    """
    kept = {f.name: f for f in steps.schema.fields}
    own = T.StructType([kept[c] for c in ("unit_id", "fn_no", "fn_name")])
    for name, of in (("rule_no", T.IntegerType()), ("rule", T.StringType()), ("severity", T.StringType()), ("message", T.StringType()), ("step_no", T.IntegerType())):
        own = own.add(name, of)
    read = batch.reads(wanted)
    rows = steps.select(*[c if c in read else F.lit(None).cast(kept[c].dataType).alias(c) for c in batch.COLUMNS])
    if not wanted.isdisjoint(FUNCTION_RULES):
        own_row = functions.select("unit_id", "fn_no", "fn_name", F.lit("function").alias("kind"), "line")
        rows = rows.unionByName(own_row, allowMissingColumns=True)
    # By a hash first: numbers are compared faster than names that begin alike.
    rows = rows.repartition(*cx.FUNCTION).sortWithinPartitions(F.xxhash64(*cx.FUNCTION), *cx.FUNCTION)
    numbers = {name: (no, severity) for no, name, severity in RULES}
    run = batch.finder(wanted, max_nesting_depth, max_function_steps, numbers)
    return rows.mapInArrow(run, own.add(kept["line"]))


def function_totals(steps: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with their step count and connection flags; step-less ones get zeros."""
    label = F.when(F.col("kind").isin("action", "closure"), F.col("label"))
    cleans = F.lit(False)
    for marker in batch.CLEANUP_MARKERS:
        cleans = cleans | label.contains(marker)
    totals = steps.groupBy("unit_id", "fn_no").agg(
        F.count("*").alias("n_steps"),
        F.bool_or(label.contains(":Connect(")).alias("connects"),
        F.bool_or(cleans).alias("cleans"),
    )
    no = F.lit(False)
    return functions.join(totals, ["unit_id", "fn_no"], "left").select(
        "unit_id",
        "fn_no",
        "fn_name",
        "line",
        F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.coalesce("connects", no).alias("connects"),
        F.coalesce("cleans", no).alias("cleans"),
    )


def findings(
    steps: DataFrame,
    functions: DataFrame,
    max_nesting_depth: int = 4,
    max_function_steps: int = 50,
    rules: Iterable[str] | None = None,
    extra: Iterable[Rule] = (),
) -> DataFrame:
    """Findings of the chosen rules, by default all thirty and the caller's ``extra``.

    Sort by (unit_id, fn_no, rule_no, step_no) to list them.
    """
    extra = _checked(extra)
    known = {*RULE_NAMES, *(rule.name for rule in extra)}
    wanted = known if rules is None else set(rules)
    if unknown := wanted - known:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    extra = [rule for rule in extra if rule.name in wanted]
    on_steps, on_functions = [r for r in extra if not r.whole_function], [r for r in extra if r.whole_function]
    parts = []
    if built_in := frozenset(wanted.intersection(RULE_NAMES)):
        parts.append(_of_all(steps, functions, built_in, max_nesting_depth, max_function_steps))
    if on_steps:
        rows = cx.with_context(cx.with_siblings(steps))
        rows = rows.withColumn("trimmed", strip(F.col("label"))).withColumn("cond", strip(F.col("condition")))
        parts.append(_hits(rows, _arms_of(rows, on_steps), F.col("step_no"), extra))
    if on_functions:
        rows = function_totals(steps, functions)
        parts.append(_hits(rows, _arms_of(rows, on_functions), F.lit(None), extra))
    if not parts:
        raise ValueError("no rules chosen")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

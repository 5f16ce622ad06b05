"""What a step's surroundings say about it: depths, exits, siblings.

Each question about a subtree is a running aggregate, so no step is ever paired with the
steps around it.  All windows share the clustering (unit_id, fn_no): steps straight from
``outline`` need no shuffle, and a written step table needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.labels import first_word, is_terminator
from lumenscan.functions.windows import latest, ordered

LOOPS = ("while", "for_in", "numeric_for", "repeat_until")
CONTAINERS = ("if", "closure", *LOOPS)
FUNCTION = ["unit_id", "fn_no"]

# Labels of remote handlers and frame signals (fixed values).
CRITICAL_HANDLER = r"On(?:Server|Client)(?:Event|Invoke)|BindableEvent"
FRAME_SIGNAL = r"(?:Heartbeat|RenderStepped|Stepped)\s*:Connect\("


def has_type_check(text: Column) -> Column:
    return text.contains("type(") | text.contains("typeof(")


def with_siblings(steps: DataFrame) -> DataFrame:
    """Add the previous sibling (``prev_*``), ``dead`` and ``first_dead``.

    A step is dead when a terminator stands before it in its own sequence.
    """
    # The sequence a step stands in, as one number; a parent's parts follow each other.
    part = F.when(F.col("branch") == "then", 0).when(F.col("branch") == "else", 1).otherwise(2)
    rows = steps.withColumn("_seq", (F.coalesce("parent_no", F.lit(-1)).cast("bigint") + 1) * 3 + part)
    run = ordered(FUNCTION, ["_seq", "ordinal"])
    ends = (F.col("kind") == "action") & is_terminator(F.col("label"))
    rows = rows.select(
        "*",
        F.lag("_seq").over(run.all).alias("_prev_seq"),
        *[F.lag(c).over(run.all).alias(f"_prev_{c}") for c in ("kind", "label", "condition")],
        latest(F.col("_seq"), ends, run.before).alias("_end_seq"),
    )
    sibling = F.coalesce(F.col("_prev_seq") == F.col("_seq"), F.lit(False))
    rows = rows.withColumn("dead", F.coalesce(F.col("_end_seq") == F.col("_seq"), F.lit(False)))
    was_dead = F.coalesce(F.lag("dead").over(run.all), F.lit(False)) & sibling
    rows = rows.select(
        "*",
        (F.col("dead") & ~was_dead).alias("first_dead"),
        *[F.when(sibling, F.col(f"_prev_{c}")).alias(f"prev_{c}") for c in ("kind", "label", "condition")],
    )
    return rows.drop("_seq", "_prev_seq", "_end_seq", "_prev_kind", "_prev_label", "_prev_condition")


def with_context(steps: DataFrame) -> DataFrame:
    """Add ancestor depths and the next exit and type check behind each step.

    Every container also emits a *close* row at ``sub_end``.  Read backwards, a close row
    enters the container and its own row leaves it, so ancestor counts are running sums;
    and the nearest later exit lies in a subtree exactly if it is not behind ``sub_end``.
    """
    if "dead" not in steps.columns:
        steps = steps.withColumn("dead", F.lit(False))
    kind = F.col("kind")
    marks = F.when(kind.isin(*CONTAINERS), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    rows = steps.withColumn("is_row", F.explode(marks))
    rows = rows.withColumn("pos", F.when(F.col("is_row") == 1, F.col("step_no")).otherwise(F.col("sub_end")))
    run = ordered(FUNCTION, [F.col("pos").desc(), F.col("is_row"), F.col("step_no")])

    def ancestors(which: Column) -> Column:
        enters = F.when(which, F.when(F.col("is_row") == 0, 1).otherwise(-1)).otherwise(0)
        return F.sum(F.when(kind.isin(*CONTAINERS), enters).otherwise(0)).over(run.to).cast("int")

    def next_step(which: Column) -> Column:
        return F.min(F.when((F.col("is_row") == 1) & which, F.col("step_no"))).over(run.before)

    leaves = (kind == "action") & first_word(F.col("label")).isin("break", "return")
    checks = has_type_check(F.when(kind == "action", F.col("label")).when(kind == "if", F.col("condition")).otherwise(""))
    closure = kind == "closure"
    rows = rows.select(
        "*",
        ancestors(kind.isin(*LOOPS)).alias("loop_depth"),
        ancestors(kind == "if").alias("if_depth"),
        ancestors(closure).alias("closure_depth"),
        ancestors(F.lit(True)).alias("depth"),
        ancestors(F.col("dead")).alias("dead_depth"),
        ancestors(closure & F.col("label").rlike(CRITICAL_HANDLER)).alias("critical_depth"),
        ancestors(closure & F.col("label").rlike(FRAME_SIGNAL)).alias("frame_depth"),
        next_step(leaves).alias("_exit"),
        next_step(checks).alias("_check"),
    )
    rows = rows.filter("is_row = 1").select(
        "*",
        (F.col("loop_depth") > 0).alias("in_loop"),
        F.coalesce(F.col("_exit") <= F.col("sub_end"), F.lit(False)).alias("has_exit"),
        F.coalesce(F.col("_check") <= F.col("sub_end"), F.lit(False)).alias("has_check"),
    )
    return rows.drop("is_row", "pos", "_exit", "_check")


def step_context(steps: DataFrame) -> DataFrame:
    """Per step: in_loop and the number of enclosing ifs, loops and closures."""
    return with_context(steps).select(
        "unit_id", "fn_no", "step_no", "kind", "in_loop", "if_depth", "loop_depth", "closure_depth"
    )


def exits(steps: DataFrame) -> DataFrame:
    """Containers whose subtree holds a ``break`` or ``return`` action."""
    return with_context(steps).filter(F.col("kind").isin(*CONTAINERS) & F.col("has_exit")).select(
        "unit_id", "fn_no", "step_no", "kind"
    )


def type_checks(steps: DataFrame) -> DataFrame:
    """Containers whose subtree holds a type check."""
    return with_context(steps).filter(F.col("kind").isin(*CONTAINERS) & F.col("has_check")).select(
        "unit_id", "fn_no", "step_no", "kind"
    )


def total_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("unit_id", "fn_no", "fn_name").agg(F.count("*").alias("n_steps"))


def max_depth(steps: DataFrame) -> DataFrame:
    """Deepest nesting per function; an empty container counts as a level."""
    level = F.col("depth") + F.col("kind").isin(*CONTAINERS).cast("int")
    return with_context(steps).groupBy("unit_id", "fn_no", "fn_name").agg(F.max(level).alias("max_depth"))


def corpus_max_depth(steps: DataFrame) -> DataFrame:
    return max_depth(steps).agg(F.coalesce(F.max("max_depth"), F.lit(0)).alias("max_depth"))


def function_labels(steps: DataFrame) -> DataFrame:
    """Action labels and closure call labels, one row each, in step order by ``step_no``."""
    return steps.filter(F.col("kind").isin("action", "closure")).select(
        "unit_id", "fn_no", "fn_name", "step_no", "label"
    )


def terminators(steps: DataFrame) -> DataFrame:
    return steps.filter((F.col("kind") == "action") & is_terminator(F.col("label"))).select(
        "unit_id", "fn_no", "step_no", first_word(F.col("label")).alias("word")
    )

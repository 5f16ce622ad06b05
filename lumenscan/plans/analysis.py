"""One analysis of a corpus: each stage is written once and read by all that need it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame

from lumenscan.operators.lexing import text_partitions
from lumenscan.operators.outline import MIN_CLOSURE_CHARS, functions_of, outline, steps_of
from lumenscan.operators.rules import Rule, findings
from lumenscan.session import write_stage


class Analysis:
    """Stages over ``units``; thresholds are the detector's two settings, ``extra_rules`` the caller's own.

    ``stored`` says that ``units`` already are a table in storage, which need not be copied.
    """

    def __init__(
        self,
        units: DataFrame,
        max_nesting_depth: int = 4,
        max_function_steps: int = 50,
        min_closure_chars: int = MIN_CLOSURE_CHARS,
        stored: bool = False,
        extra_rules: Iterable[Rule] = (),
    ):
        self._units, self._stored, self._min_closure_chars = units, stored, min_closure_chars
        self._limits, self._extra_rules = (max_nesting_depth, max_function_steps), tuple(extra_rules)

    @cached_property
    def units(self) -> DataFrame:
        return self._units if self._stored else write_stage(self._units, "units")

    @cached_property
    def outline(self) -> DataFrame:
        return write_stage(outline(self.units, self._min_closure_chars, text_partitions(self.units)), "outline")

    @property
    def functions(self) -> DataFrame:
        return functions_of(self.outline)

    @property
    def steps(self) -> DataFrame:
        return steps_of(self.outline)

    @cached_property
    def findings(self) -> DataFrame:
        return write_stage(findings(self.steps, self.functions, *self._limits, extra=self._extra_rules), "findings")

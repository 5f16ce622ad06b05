"""Results kept by content: a text is analysed once, whatever its copies and in whichever run.

The key of a result is the SHA-256 of the text and the version of the lexer.  A run looks its
texts up, derives what is missing from one file of each new text, appends that to the store and
gives every file the rows of its text.  Rows are written before their keys, so a run that is lost
in between leaves rows that no key names, and they are never read.  Two runs at once may derive the
same text; the rows of the run that sorts first are taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan import LEXER_VERSION
from lumenscan.session import write_stage

# Files with the same text that one task serves; a text with more is served by several.
COPIES_PER_TASK = 100_000


class ContentStore:
    """A folder of results by content, one table for each kind of result.

    ``path`` is a folder all executors share.  Results of another ``version`` are left alone.
    """

    def __init__(self, spark: SparkSession, path: str, version: str = LEXER_VERSION, copies_per_task: int = COPIES_PER_TASK):
        self._spark, self._path, self._version, self._copies = spark, path.rstrip("/"), version, copies_per_task

    def _table(self, kind: str, part: str, columns: str) -> DataFrame:
        """A table of the store; without rows before its first run."""
        root, schema = f"{self._path}/{kind}/{part}", f"{columns}, version string, run string"
        try:
            return self._spark.read.schema(schema).option("basePath", root).parquet(root).filter(F.col("version") == self._version)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, kind: str, part: str, run: str) -> None:
        rows.write.parquet(f"{self._path}/{kind}/{part}/version={self._version}/run={run}")

    def keys(self, kind: str) -> DataFrame:
        """``content_sha2`` and ``run`` of every text with results of this kind."""
        return self._table(kind, "keys", "content_sha2 string").groupBy("content_sha2").agg(F.min("run").alias("run"))

    def update(self, units: DataFrame, kind: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Derive and keep what the store lacks; ``unit_id`` and ``content_sha2`` of the readable files.

        One file stands for each new text, chosen by sums that pre-aggregate, so only new
        texts are shuffled and many copies of one are no hot group.
        """
        keyed = _keyed(units)
        chosen = keyed.groupBy("content_sha2").agg(F.min("unit_id").alias("unit_id"))
        chosen = chosen.join(self.keys(kind), "content_sha2", "left_anti")
        fresh = keyed.join(chosen, ["unit_id", "content_sha2"], "left_semi")
        texts = fresh.select(
            F.col("content_sha2").alias("unit_id"), F.lit("").alias("location"), "content", "content_sha2", F.lit(True).alias("valid_utf8")
        )
        texts = write_stage(texts, f"new-{kind}")
        if not texts.isEmpty():
            run = f"r-{uuid.uuid4().hex}"
            self._append(derive(texts).withColumnRenamed("unit_id", "content_sha2"), kind, "rows", run)
            self._append(texts.select("content_sha2"), kind, "keys", run)
        return keyed.select("unit_id", "content_sha2")

    def rows(self, units: DataFrame, kind: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``derive(units)``, with new texts derived now and all others read from the store.

        ``derive`` maps units to rows with their ``unit_id``; its rows may depend on the text
        alone.  ``unit_id`` must be unique (``job_invariants`` tells).  Unreadable files and those
        without a text give no rows.
        """
        files = self.update(units, kind, derive)
        shape = derive(units.limit(0)).drop("unit_id").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
        kept = self._table(kind, "rows", f"content_sha2 string, {columns}")
        kept = kept.join(self.keys(kind), ["content_sha2", "run"], "left_semi").drop("version", "run")
        # A text with very many files is served by several tasks: its rows are repeated, its files dealt.
        many = files.groupBy("content_sha2").agg(F.ceil(F.count("*") / self._copies).alias("_tasks")).filter("_tasks > 1")
        tasks = F.coalesce("_tasks", F.lit(1))
        files = files.join(many, "content_sha2", "left").withColumn("_task", F.pmod(F.xxhash64("unit_id"), tasks)).drop("_tasks")
        kept = kept.join(many, "content_sha2", "left").withColumn("_task", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks.cast("bigint") - 1)))
        return files.join(kept.drop("_tasks"), ["content_sha2", "_task"]).select("unit_id", *[f"`{f.name}`" for f in shape.fields])


def _keyed(units: DataFrame) -> DataFrame:
    """Readable units with the key of their text."""
    key = F.coalesce("content_sha2", F.sha2("content", 256))
    return units.filter(F.col("valid_utf8") & F.col("content").isNotNull()).select("unit_id", key.alias("content_sha2"), "content")

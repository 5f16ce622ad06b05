"""Toxicity: documents scored by a recurrent network over all their overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.recurrent import Scorer, sigmoid, train
from lumenscan.llm.tables import by_bytes, releasing

#: The bounded sample for training: most texts of each label, and most characters of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 8_000
WINDOW, STRIDE = 64, 32


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """A trained scorer; ``network`` is null if the labels teach nothing, ``base`` then is every score."""

    def __init__(self, network, base: float):
        self.network, self.base = network, base

    def scores(self, scorer: Scorer | None, texts: list[str]) -> np.ndarray:
        if scorer is None:
            return np.full(len(texts), self.base)
        logits = scorer.score(texts).astype(np.float64)
        return np.where(np.isnan(logits), self.base, sigmoid(np.nan_to_num(logits)))

    def scorer(self) -> Scorer | None:
        return Scorer(self.network, WINDOW, STRIDE) if self.network else None


def fit(docs: DataFrame, labels: DataFrame, steps: int = 200) -> Model:
    """Train on a bounded sample: SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents of at most SAMPLE_CHARS characters.

    They are those with the smallest hashes of their ids outside the held-out fold, so the sample
    does not depend on the partitions. Ids with no or both labels and nulls are left out.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("id"))
    known = known.agg(F.min("toxic").alias("y"), F.max("toxic").alias("y_max")).filter("y = y_max")
    known = known.filter(~held_out(F.col("id"))).select("id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    base = counts.get(1, 0) / max(sum(counts.values()), 1)
    # Only ids and lengths are shuffled to choose the sample; its ids are few, so they go to the texts.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    usable = known.join(rows.select("id").distinct(), "id", "left_semi")
    chosen = None
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sorted(texts.collect(), key=lambda r: (r["y"], r["id"]))  # bounded by SAMPLE_*
    if len({r["y"] for r in sample}) < 2:
        return Model(None, min(base, 0.49))
    return Model(train([r["text"] for r in sample], [r["y"] for r in sample], WINDOW, steps), min(base, 0.49))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; no shuffle.

    The score of a text is the network's probability for the most toxic of its overlapping
    windows of WINDOW tokens, which cover the whole text. Only the text is an input. A null text
    or one without words has the share of toxic labels as its score, below 0.5. Null and repeated
    doc_ids are kept row by row; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in by_bytes(batches, "text", 1 << 20):
            found = model.scores(scorer, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, all columns as they are; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            yield batch.filter(pa.array(model.scores(scorer, texts) < 0.5))

    return docs.mapInArrow(releasing(run), docs.schema)

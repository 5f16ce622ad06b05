"""From raw documents to training sequences: toxic texts go, near-copies go, sources are mixed, tokens are packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
``docs`` of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenscan.llm import mixing, packing, simhash, toxicity
from lumenscan.llm.tables import documents, table
from lumenscan.llm.token_counts import token_length
from lumenscan.session import write_stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labels of ``docs``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints of three-word shingles that differ in two bits at most."""
    return simhash.keep_one(docs, words_each=3, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; tempered weights read a small source up to twice as often as a large one.

    Sources are weighted by their tokens, as the packing counts them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.in_mix_order(docs, parts, max_repeats=2.0, tokens=token_length(TOKENIZER, "word")("text"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens in the mixed order."""
    packed = packing.pack(docs, TOKENIZER, "word", end_id=1, length=2048)
    return packing.piece_digests(packed)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Neither the network nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

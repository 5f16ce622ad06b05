"""One query for each operator, with production parameters and over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lumenscan.llm import backoff, ball_codes, id_files, mixing, order_minhash, packing, sql, top_k, toxicity, variants, vectors, warc
from lumenscan.llm import simhash as sh
from lumenscan.llm.tables import documents, table
from lumenscan.llm.token_counts import token_counts, token_length
from lumenscan.session import write_stage

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), "byte", limit=1024)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their tokens. Texts are read once, for their lengths and keys."""
    lengths = token_length(public_tokenizers.path(WORD_BPE), "word")("text")
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.row_key().alias("key"), lengths.alias("n_tokens"))
    mixed = mixing.mixed_rows(write_stage(docs, "mix-lengths"), max_repeats=2.0, tokens=F.col("n_tokens"), key=F.col("key"))
    return mixed.select(
        "mix_row.doc_id", "mix_row.source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_block").alias("block"), "mix_order",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), "word", end_id=1, length=2048))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_fingerprints(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"), least=1000).drop("url")


def _scores(scores: DataFrame) -> DataFrame:
    """Scores to six digits, as sums of logarithms depend on their order beyond that."""
    return scores.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams, backing off to what other documents have."""
    return _scores(backoff.backoff_scores(documents(spark, sf_dir), order=3))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sh.simhash_groups(documents(spark, sf_dir), words_each=3, distance=2)
    return groups.select("doc_id", sh.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.id_file_index(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), "word", end_id=2)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir), least_length=6, least_count=5, ratio=5, one_in=199)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.code_digests(*ball_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_vectors": op5_vectors,
    "op6_order_minhash": op6_order_minhash,
    "op7_warc": op7_warc,
    "op8_backoff": op8_backoff,
    "op9_simhash": op9_simhash,
    "op10_id_files": op10_id_files,
    "op11_variants": op11_variants,
    "op12_top_k": op12_top_k,
    "op13_ball_codes": op13_ball_codes,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op7_warc": sql.WARC,
    "op8_backoff": sql.BACKOFF,
    "op11_variants": sql.VARIANTS,
    "op12_top_k": sql.TOP_K,
    "op13_ball_codes": sql.BALL_CODES,
}

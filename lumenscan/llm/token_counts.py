"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.encoding import encoder
from lumenscan.llm.tables import by_bytes, id_and_text, to_arrow

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer: str, kind: str, limit: int = 1024, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the file of a ``tokenizers`` tokenizer, ``kind`` says where its texts may be
    cut (see ``encoding``). There is no shuffle: each task encodes its part of the scan in batches
    of ``batch_bytes``, and only lengths leave Python. A longer text is a batch of its own.

    A null or empty text has 0 bytes and 0 tokens. Null and repeated doc_ids are kept as they
    are, row by row; an empty table gives an empty one; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer, kind, lengths_only=True).lengths
        for batch in by_bytes(batches, "text", batch_bytes):
            n = lengths(batch.column("text"))
            size = np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)
            yield to_arrow({"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}, _SCHEMA)

    return id_and_text(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def token_length(tokenizer: str, kind: str, batch_bytes: int = 4 << 20) -> Callable[[str], Column]:
    """A column function: the number of tokens of a text, 0 for null. Plans that do not use it drop it."""

    @F.arrow_udf("bigint")
    def length(texts: pa.Array) -> pa.Array:
        filled = pa.RecordBatch.from_arrays([pc.fill_null(texts, "")], names=["text"])
        run = encoder(tokenizer, kind, lengths_only=True).lengths
        found = [run(part.column("text")) for part in by_bytes([filled], "text", batch_bytes)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *found]))

    return length

"""Stupid-backoff language-model scores, from n-gram counts of all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.hashing import WordHashes, mix
from lumenscan.session import write_stage

#: Text of a chunk, in which n-grams are counted before they are shuffled.
CHUNK_BYTES = 12 << 20
#: Text for each partition of the count tables.
BUCKET_BYTES = 16 << 20


_WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text``: runs without ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def _ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for each length the hash of the n-gram that ends at each word.

    At the first words of a text, where the n-gram would reach over its beginning, it is cut
    off there; ``_present`` says where it is whole.
    """
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    words = mix(np.concatenate([np.zeros(0, np.uint64), *map(_WORDS.of, lists)]))
    out = [words]
    for _ in range(order - 1):
        longer = words.copy()
        longer[1:] = mix(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        out.append(longer)
    return sizes, out


def _present(sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length, where an n-gram of that length ends."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [place >= n for n in range(order)]


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, lowest first, and compressed: their high bytes are mostly zeros."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(stored: bytes) -> np.ndarray:
    n = int.from_bytes(stored[:8], "little")
    planes = np.frombuffer(pa.decompress(stored[8:], n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _dealt(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task with the number of their chunk, which is the same whenever they are read."""
    before = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        nth = (before + np.cumsum(sizes) - sizes) // chunk_bytes
        before += int(sizes.sum())
        cuts = (np.flatnonzero(np.diff(nth)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield (batch.column("part")[0].as_py() << 32) + int(nth[a]), batch.slice(a, b - a)


def _texts(chunk_bytes: int):
    """Rows on their way to their chunk: packed Arrow batches of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _dealt(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

    return run


_ASKED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _requests(order: int, buckets: int, chunk_bytes: int):
    """The distinct n-grams of each chunk with their counts there, dealt to buckets by ranges of their hash."""

    def asked(chunk: int, texts: list[str | None]) -> pa.RecordBatch:
        sizes, grams = _ngrams(texts, order)
        out = []
        for n, present in enumerate(_present(sizes, order)):
            distinct, counts = np.unique(grams[n][present], return_counts=True)
            bucket = (distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(distinct)]))
            for a, b in zip(begins, ends) if len(distinct) else ():
                out.append((chunk, n, int(bucket[a]), _pack(np.diff(distinct[a:b], prepend=np.uint64(0))), _pack(counts[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, _ASKED)], schema=_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for chunk, rows in _dealt(batches, chunk_bytes):
            if chunk != now and held:
                yield asked(now, held)
                held = []
            now = chunk
            held += rows.column("text").to_pylist()
        if held:
            yield asked(now, held)

    return run


def _totals(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All n-grams of one bucket and length with their counts over all documents."""
    grams = [np.cumsum(_unpack(x), dtype=np.uint64) for x in rows.column("grams").to_pylist()]
    counts = np.concatenate([_unpack(x) for x in rows.column("counts").to_pylist()])
    each = np.concatenate(grams)
    order = np.argsort(each, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], each[order][1:] != each[order][:-1])))
    return each[order][begins], np.add.reduceat(counts[order].astype(np.int64), begins), grams


def _replies(rows: pa.Table) -> pa.Table:
    """The count table of one bucket joined to the n-grams each chunk has there, in the chunk's order."""
    known, totals, grams = _totals(rows)
    out = [_pack(totals[np.searchsorted(known, g)]) for g in grams]
    return pa.Table.from_arrays(
        [rows.column(c) for c in ("chunk", "n", "bucket")] + [pa.chunked_array([pa.array(out, pa.binary())])], names=["chunk", "n", "bucket", "totals"]
    )


def _count_table(rows: pa.Table) -> pa.Table:
    known, totals, _ = _totals(rows)
    return pa.table({"n": pa.array(np.full(len(known), rows.column("n")[0].as_py() + 1, np.int32)), "gram": known.view(np.int64), "count": totals})


def _elsewhere(gram: np.ndarray, doc: np.ndarray, replies: list[np.ndarray]) -> np.ndarray:
    """How often the n-gram at each place occurs in other documents: its count less that of its own document."""
    distinct, inverse = np.unique(gram, return_inverse=True)
    if not len(distinct):
        return np.zeros(0)
    told = np.concatenate(replies)
    if len(told) != len(distinct):
        raise ValueError("the rows of a chunk were not the same when they were read again")
    _, own, times = np.unique(inverse * (int(doc[-1]) + 1) + doc, return_inverse=True, return_counts=True)
    return (told[inverse].astype(np.int64) - times[own]).astype(np.float64)


def _scores(order: int, min_count: int, backoff: float):
    """Per document: words, the sum of log scores without log N, and how often N divides."""

    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        docs = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed.column("rows")])
        sizes, grams = _ngrams(docs.column("text").to_pylist(), order)
        total = int(sizes.sum())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        answers: dict[int, list] = {}
        for n, bucket, found in sorted(zip(*(replies.column(c).to_pylist() for c in ("n", "bucket", "totals")))):
            answers.setdefault(n, []).append(_unpack(found))
        whole, count = _present(sizes, order), []
        for n, present in enumerate(whole):
            full = np.zeros(total, np.float64)
            full[present] = _elsewhere(grams[n][present], doc[present], answers.get(n, []))
            count.append(full)
        log = np.zeros(total)
        open_, weight = np.ones(total, bool), np.zeros(total)
        for n in range(order - 1, 0, -1):
            context = np.concatenate(([0.0], count[n - 1][:-1])) if total else count[n - 1]
            seen = open_ & whole[n] & (count[n] >= min_count)
            log[seen] = weight[seen] + np.log(count[n][seen]) - np.log(context[seen])
            open_ &= ~seen
            weight[open_ & whole[n]] += np.log(backoff)
        new = open_ & (count[0] < 1)
        weight[new] += np.log(backoff)
        log[open_] = weight[open_] + np.log(np.maximum(count[0][open_], 1))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        some = np.flatnonzero(sizes)
        sums, plain = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        if len(some):
            sums[some] = np.add.reduceat(log, ends[:-1][some])
            plain[some] = np.add.reduceat(open_.astype(np.int64), ends[:-1][some])
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": sizes, "sum_log": sums, "n_unigram": plain})

    return run


def _parts(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.withColumn("part", F.spark_partition_id().cast("bigint")), -(-total // bucket_bytes) or 1


_ASKS = "chunk bigint, n int, bucket bigint, grams binary, counts binary"


def ngram_counts(docs: DataFrame, order: int = 2, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The count tables: n, gram (64-bit hash), count over all documents, partitioned by hash."""
    rows, buckets = _parts(docs, bucket_bytes)
    asked = rows.mapInArrow(_requests(order, buckets, chunk_bytes), _ASKS)
    return asked.groupBy("n", "bucket").applyInArrow(_count_table, "n int, gram bigint, count bigint")


def backoff_scores(
    docs: DataFrame, order: int = 3, min_count: int = 1, backoff: float = 0.4, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """doc_id, n_tokens, log_score, mean_log_score of every row of ``docs``.

    The score of a word after its context is count(n-gram) / count(context) if the n-gram occurs
    at least ``min_count`` times in other documents, else ``backoff`` times the score after a
    context shorter by one word; a lone word scores count / number of words, and one that no other
    document has ``backoff`` times that of a word met once. All counts are over all documents less
    those of the scored document itself (one word at least), so no text vouches for itself; a copy of it does.
    log_score sums the logarithms. At the beginning of a text the context is what there is,
    without a penalty. n-grams are 64-bit hashes: two that share a hash share their count, which
    among a billion different ones happens about once in forty corpora.

    The rows of a task are dealt into chunks of ``chunk_bytes``, in the order in which they are read. The distinct n-grams of a chunk and their
    counts go to the partition of their hash, where all counts of an n-gram are added up and
    joined back to the n-grams of the chunks; only the counts return, in the order that the chunk
    knows. So a frequent n-gram is one entry per chunk, and the texts move once.

    A null text is empty; texts without words have n_tokens 0, log_score 0 and no mean. Null and
    repeated doc_ids are scored row by row; an empty table gives an empty one; other columns
    are ignored.
    """
    rows, buckets = _parts(docs, bucket_bytes)
    asked = rows.mapInArrow(_requests(order, buckets, chunk_bytes), _ASKS)
    told = asked.groupBy("n", "bucket").applyInArrow(_replies, "chunk bigint, n int, bucket bigint, totals binary")
    texts = rows.mapInArrow(_texts(chunk_bytes), "chunk bigint, rows binary")
    scored = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _scores(order, min_count, backoff), "doc_id bigint, n_tokens bigint, sum_log double, n_unigram bigint"
    )
    scored = write_stage(scored, "backoff")
    words = scored.agg(F.sum("n_tokens")).first()[0] or 0
    elsewhere = F.greatest(F.lit(words) - F.col("n_tokens"), F.lit(1))
    log = F.col("sum_log") - F.col("n_unigram") * F.ln(elsewhere)
    return scored.select("doc_id", "n_tokens", log.alias("log_score")).withColumn(
        "mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    )

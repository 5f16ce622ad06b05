"""Spelling variants: words one edit apart, found by composing automata, and the form each is a variant of."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.automata import Acceptor, one_edit_pairs
from lumenscan.llm.tables import by_bytes, id_and_text
from lumenscan.session import write_stage

#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: Rows of a bucket, and words of a partition that a task composes; larger partitions are divided.
#: With one symbol left there are no more than 90 + 90 ** 2 different words, so a division ends below this.
BUCKET_ROWS, HELD = 1 << 15, 1 << 14
#: Letters by their Latin-1 bytes, A-Z in lower case; all else is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, a byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(doc_id: int | None, run: bytes, one_in: int) -> bytes:
    """``run``, without one code point if the CRC-32 of ``<doc_id>:<run>`` is divisible by ``one_in``."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, run if run.isascii() else run.decode("latin-1").encode()))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6, one_in: int | None = None) -> DataFrame:
    """word, n: the occurrences of every word of at least ``least_length`` code points.

    With ``one_in``, runs are damaged as in ``damaged``. Tasks count before anything is shuffled,
    and pass their counts on when they hold COUNTED words.
    """

    def passed(total: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in by_bytes(batches, "text", 1 << 22):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(runs_of(text)).items():
                    if one_in:
                        word = damaged(doc_id, word, one_in)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > COUNTED:
                    yield passed(total)
                    total = Counter()
        yield passed(total)

    counted = id_and_text(docs).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


_KEY = ["kind", "prefix", "suffix", "upto"]


def _sides(word: Column, kind: Column, prefix: Column, suffix: Column, upto: Column) -> Column:
    """Both halves of a partition: its words share more at the beginning, or more at the end.

    Words of a partition share ``prefix`` and ``suffix``, and are of ``kind`` symbols or one more.
    Two of them that first differ behind the first half of what is left of the shorter one share
    that half as well; others, which differ before, share the second half. ``upto`` is the place
    before which words of the partition must differ.
    """
    begin = F.length(prefix)
    left = kind - begin - F.length(suffix)
    cut = begin + F.floor(left / 2).cast("int")
    end = F.length(suffix) + left - (cut - begin)
    return F.array(
        F.struct(kind.alias("kind"), F.substring(word, F.lit(1), cut).alias("prefix"), suffix.alias("suffix"), upto.alias("upto")),
        F.struct(kind.alias("kind"), prefix.alias("prefix"), F.right(word, end).alias("suffix"), cut.alias("upto")),
    )


def _partitions(vocabulary: DataFrame) -> DataFrame:
    """word, n and the key of every partition that a word is in."""
    size = F.length("word")
    kinds = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter("size > 0")
    none = F.lit("")
    sides = F.explode(_sides(F.col("word"), F.col("size"), none, none, F.lit(2**31 - 1)))
    return kinds.select("word", "n", sides.alias("side")).select("word", "n", "side.*")


def _divided(rows: DataFrame, held: int) -> DataFrame:
    """The rows with partitions of more than ``held`` words divided, again and again, until none is left."""
    done = []
    while True:
        left = F.col("kind") - F.length("prefix") - F.length("suffix")
        sizes = rows.filter(left > 1).groupBy(*_KEY).count()
        hot = write_stage(sizes.filter(F.col("count") > held).select(*_KEY), "hot-partitions")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, _KEY, "left_anti").select(*rows.columns))
        sides = F.explode(_sides(F.col("word"), *[F.col(c) for c in _KEY])).alias("side")
        rows = write_stage(rows.join(hot, _KEY, "left_semi").select("word", "n", sides).select("word", "n", "side.*"), "divided")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compose(rows: pa.Table) -> pa.Table:
    """Of every word of a bucket the near words found there: their number, and the best of them with its count."""
    words, kinds, uptos = (rows.column(c).to_pylist() for c in ("word", "kind", "upto"))
    prefixes, suffixes = rows.column("prefix").to_pylist(), rows.column("suffix").to_pylist()
    partitions: dict[tuple, list[tuple[str, int]]] = {}
    for i, (word, *key) in enumerate(zip(words, kinds, prefixes, suffixes, uptos)):
        middle = word[len(key[1]) : len(word) - len(key[2])]
        partitions.setdefault(tuple(key), []).append((middle, i))
    acceptor, starts = Acceptor(), []
    for key, members in partitions.items():
        if len(members) > 1:
            members.sort()
            starts.append((acceptor.start([m for m, _ in members]), key, [i for _, i in members]))
    near = one_edit_pairs(acceptor)
    left, right = [], []
    for state, (kind, _, _, upto), members in starts:
        for a, b in near[state]:
            i, j = members[a], members[b]
            # Two longer words meet in their own kind, and those that differ later in the other half.
            if len(words[i]) + len(words[j]) <= 2 * kind + 1 and words[i][:upto] != words[j][:upto]:
                left.append(i)
                right.append(j)
    one, other = np.array(left + right, np.int64), np.array(right + left, np.int64)
    n = np.asarray(rows.column("n"))
    # Words by rank, so that numbers settle ties as the words themselves would.
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(one), 1), bool), one[1:] != one[:-1])))
    columns = [
        pa.array([words[i] for i in one[first]], pa.string()), np.diff(np.append(first, len(one))), n[other[first]],
        pa.array([words[i] for i in other[first]], pa.string()),
    ]
    return pa.table([pa.array(c) for c in columns], names=["word", "n_near", "best_n", "best"]).cast(_NEAR)


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(vocabulary: DataFrame, held: int = HELD) -> DataFrame:
    """word, n, n_near, best, best_n: how many words are one edit apart, and the most frequent of them.

    Two words one edit apart are equal in the first or in the second half of the shorter one. So
    every word joins the partition of each of its halves, for its own length and, as the longer
    one, for the length below. The words of a partition are those that the automaton of the whole
    vocabulary accepts from one state, reached by the half they share (a state of the reversed
    automaton, for second halves). Partitions are hashed into buckets; a task builds the minimised
    acceptor of what is left of the words of its partitions, with one initial state for each, and
    composes it with the transducer and itself. Only sums per word leave the task, no pairs.

    A partition of more than ``held`` words is divided in halves the same way, over the cluster.
    """
    rows = write_stage(_divided(write_stage(_partitions(vocabulary), "word-partitions"), held), "word-buckets")
    buckets = -(-rows.count() // BUCKET_ROWS) or 1
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(_compose, "word string, n_near bigint, best_n bigint, best string")
    best = F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("best"))
    both = found.select("word", F.lit(0).cast("bigint").alias("n"), "n_near", best.alias("b")).unionByName(
        vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<low:bigint,best:string>").alias("b"))
    )
    return both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b")).select(
        "word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.low")).alias("best_n")
    )


def _last_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms from every word that has one.

    Chains are halved in every round. A form is several times as frequent as its word, so they are
    short: their length is a logarithm of the largest count.
    """
    now = write_stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = now.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step = write_stage(step, "forms")
        if step.filter("moved").isEmpty():
            return now
        now = step.drop("moved")


def spelling_variants(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, one_in: int | None = None, held: int = HELD
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs ``least_count`` times in all texts.

    Words are maximal runs of letters (see ``runs_of``) of at least ``least_length`` code points.
    A word's form is the most frequent word one insertion, deletion or replacement away (ties: the
    smallest in code-point order) if that is ``ratio`` times as frequent, and null otherwise; its
    root is where the forms end, itself if it has none. ``ratio`` is at least 2.

    A null text has no words; a null doc_id reads as the empty text where it is hashed. Repeated
    rows and ids count row by row. Texts and words may be of any length. An empty table gives an
    empty one; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    vocabulary = write_stage(word_counts(docs, least_length, one_in).filter(F.col("n") >= least_count), "vocabulary")
    has_form = F.col("best_n") >= F.col("n") * ratio
    known = write_stage(near_words(vocabulary, held).select(
        "word", F.when(has_form, F.col("best")).alias("form"), "n", "n_near", F.when(has_form, F.col("best_n")).alias("form_n")
    ), "near-words")
    roots = _last_forms(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

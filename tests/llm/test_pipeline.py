"""The pipeline stage by stage, and every query of the subpackage, on the smallest tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lumenscan.llm import mixing, toxicity
from lumenscan.llm.queries import QUERIES, SQL
from lumenscan.llm.tables import documents, table
from lumenscan.llm.token_counts import token_length

from .test_near_copies import plain_fingerprint, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read again in between."""
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_return_the_columns_of_documents(stages):
    want = stages[0][1].dtypes
    assert all(got.dtypes == want for _, _, got in stages[:-1])
    assert [name for name, *_ in stages] == ["toxicity", "simhash near-dedup", "mixing", "packing"]


def test_toxic_documents_go(spark, stages):
    _, docs, got = stages[0]
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    assert rows(got) == rows(docs.filter(docs.doc_id.isin(list(clean))))
    assert got.count() > 0.8 * docs.count()


def test_one_of_each_group_stays(stages):
    _, docs, got = stages[1]
    prints = sorted((r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect())
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2]
    first = {prints[root][0] for root in union(len(prints), near)}
    assert rows(got) == rows(docs.filter(docs.doc_id.isin(list(first)))) and 0 < len(first) < len(prints)


def test_mixing_keeps_everything_and_repeats_small_sources(stages):
    _, docs, got = stages[2]
    before, after = rows(docs), rows(got)
    assert set(before) == set(after) and max(after.values()) <= 2
    lengths = token_length(public_tokenizers.path("word_bpe_49k.json"), "word")
    assert after == rows(mixing.mix(docs, max_repeats=2.0, tokens=lengths("text")).select(*docs.columns))


def test_packing_holds_every_token(stages):
    _, docs, got = stages[3]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    copies, used = Counter(r.doc_id for r in docs.collect()), Counter()
    for r in got.collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        used[r.doc_id] += r.length
    assert used == Counter({i: n * len(ids[i]) for i, n in copies.items()})


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count()


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("pipeline", "op11_variants", "op12_top_k")])
def test_queries_give_a_row_for_each_row(spark, name):
    df = entry.queries()[name](spark, SF)
    of = {"op5_vectors": "embeddings", "op13_ball_codes": "embeddings", "op7_warc": "pages"}.get(name, "documents")
    key = df.columns[0]
    want = {r[0] for r in table(spark, SF, of).select(key).collect()}
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == want and (len(got) == len(want) or name in ("op3_mixing", "op4_packing"))


def test_queries_equal_sql(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(entry.__file__).parent / "tools"))
    from check import compare, connect

    db = connect(SF)
    for name in SQL:
        assert compare(spark, db, name, SF).startswith("ok"), name

"""Token counts, packing and token-id files against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenscan.llm import id_files, packing, simple8b
from lumenscan.llm.encoding import PieceEncoder
from lumenscan.llm.token_counts import token_counts

from .conftest import ODD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
KINDS = {BYTE: "byte", WORD: "word"}
TOKENIZER = {path: Tokenizer.from_file(path) for path in KINDS}


def ids_of(path, text, end=None):
    ids = TOKENIZER[path].encode(text or "", add_special_tokens=False).ids
    return np.array(ids + ([] if end is None else [end]), "<u4")


@pytest.mark.parametrize("path", KINDS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB's \n\t\r.,!19é́  \x1c\x85ﬁ日|<>"), max_size=40), min_size=1, max_size=4))
def test_pieces_give_the_ids_of_the_text(path, texts):
    texts = [*texts, *(t + "<|endoftext|> x" + t for t in texts)]
    ids, bounds = PieceEncoder(path, KINDS[path]).ids(pa.array(texts), None)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == ids_of(path, text).tolist()
    assert PieceEncoder(path, KINDS[path], True).lengths(pa.array(texts)).tolist() == np.diff(bounds).tolist()


def test_a_word_between_marks_is_encoded_once(monkeypatch):
    """Case and marks around a word make no new word, and words of several batches outlive those met once."""
    monkeypatch.setattr("lumenscan.llm.encoding.CACHE_PIECES", 60)
    run, met = PieceEncoder(WORD, "word"), []
    plain = run._letters.word_ids
    monkeypatch.setattr(run._letters, "word_ids", lambda word: met.append(word) or plain(word))
    for i in range(60):
        texts = ["Often often, (often) OFTEN!", f"once{chr(192 + i)} x{chr(192 + i)}y. <|endoftext|> don't Él, 1st"]
        ids, bounds = run.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(WORD, t).tolist() for t in texts]
    assert met.count("often") == 1
    assert len(run._count) < 70


@pytest.mark.parametrize("path", KINDS)
def test_a_long_text_with_odd_spaces_is_cut_safely(path):
    text = "plain words, then odd 'll ones\t " * 3000
    assert PieceEncoder(path, KINDS[path], True).lengths(pa.array([text])).tolist() == [len(ids_of(path, text))]


@pytest.mark.parametrize("path", KINDS)
def test_counts_of_odd_documents(odd_docs, path):
    got = sorted(map(tuple, token_counts(odd_docs, path, KINDS[path], limit=1024, batch_bytes=1000).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(ids_of(path, t)), n > 1024) for i, t in ODD]
    assert got == sorted(want, key=str)


def test_empty_tables(no_docs):
    assert token_counts(no_docs, BYTE, "byte").collect() == []
    assert packing.pack(no_docs, WORD, "word", 1).collect() == []
    assert id_files.id_file_index(no_docs, WORD, "word", 2).collect() == []


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_packing_cuts_every_id_once(odd_docs, docs_of, length):
    docs = odd_docs if length > 1 else docs_of([r for r in ODD if len(r[1] or "") < 100])
    rows = packing.pack(docs, WORD, "word", end_id=1, length=length).collect()
    stream = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in stream:  # gapless from the first sequence on
        assert (r.sequence_id, r.offset) == divmod(place, length) and len(r.ids) == 4 * r.length
        place += r.length
    built, docs_read = [], 0
    for r in stream:
        if r.start == 0:
            built = []
        built.append(r.ids)
        if r.start + r.length == r.doc_tokens:
            docs_read += 1
            ids = np.frombuffer(b"".join(built), "<u4")
            assert len(ids) == r.doc_tokens
            assert any(i == r.doc_id and ids.tolist() == ids_of(WORD, t, 1).tolist() for i, t in ODD)
    assert docs_read == docs.count()
    digests = packing.piece_digests(packing.pack(docs, WORD, "word", end_id=1, length=length)).collect()
    assert sorted(d.ids_crc32 for d in digests) == sorted(zlib.crc32(r.ids) for r in rows)


def test_narrow_ids_round_trip():
    for ids in ([], [0, 65535], [65536, 3]):
        assert packing.widen(packing.narrow(np.array(ids, np.uint32))).tolist() == ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_simple8b_round_trip(values, a, b):
    given_ = np.array(values, np.uint64)
    words, escapes = simple8b.encode(given_)
    assert simple8b.decode(words, escapes, len(values)).tolist() == values
    assert len(words) <= len(values)
    first, last = sorted((min(a, len(values)), min(b, len(values))))
    offsets = simple8b.group_offsets(words, 4)
    assert simple8b.decode_group(words, escapes, offsets, 4, first, last, len(values)).tolist() == values[first:last]


def test_simple8b_packs_small_values_densely():
    assert len(simple8b.encode(np.zeros(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(400, 2**15 - 1, np.uint64))[0]) == 100


def test_id_files_in_order_and_read_back(odd_docs, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 999)
    rows = id_files.id_file_index(odd_docs, WORD, "word", end_id=2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    place = 0
    for r in rows:
        assert r.start == place
        place += r.n_tokens
        assert any(i == r.doc_id and len(x := ids_of(WORD, t, 2)) == r.n_tokens and zlib.crc32(x.tobytes()) == r.ids_crc32 for i, t in ODD)


def test_a_damaged_block_is_noticed():
    pieces = np.zeros(1, id_files._PIECE)
    pieces["ids"] = 3
    data = bytearray(id_files.block_bytes(0, 0, 0, pieces, np.array([1, 2, 49000], np.uint32)) + id_files.SYNC)
    assert id_files.read_block(bytes(data), 0)[4].tolist() == [1, 2, 49000]
    data[60] ^= 1
    with pytest.raises(ValueError):
        id_files.read_block(bytes(data), 0)

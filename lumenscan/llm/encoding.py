"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece encoded once per batch.

A text is cut where the tokenizer itself always cuts, so that the ids of the pieces, one after
the other, are the ids of the text:

* ``word`` tokenizers drop white space and never join across it. They may be cut at any space
  or line break.
* ``byte`` tokenizers bind one space to the word behind it. With spaces and line breaks as the
  only white space, they may be cut in front of every run of them that follows something else.
  A text with other white space is cut in front of a single space between two visible ASCII
  characters only.

Added special tokens hold no white space, so no cut divides one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a Python worker remembers, and the longest one of them.
CACHE_PIECES, CACHE_CHARS = 300_000, 24
#: A word that stands between others when many are encoded as one text, and how many those are.
MARK, JOINED = "0", 200
#: Letters of words that may go to the model without a detour, if the tokenizer agrees (see ``_Letters``).
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and (c.isascii() or c >= "À"))
#: Pieces of texts with unusual white space are at least this long.
SAFE_CHARS = 4096

_BYTE_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE_SPACE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def safe_pieces(text: str, at_least: int = SAFE_CHARS) -> list[str]:
    """``text`` cut in front of single spaces between visible ASCII characters."""
    cuts, last = [0], 0
    if len(text) > at_least:
        for found in _SAFE_SPACE.finditer(text):
            if found.start() - last >= at_least:
                last = found.start()
                cuts.append(last)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def byte_pieces(text: str) -> list[str]:
    return safe_pieces(text) if _OTHER_SPACE.search(text) else _BYTE_PIECE.findall(text)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Letters:
    """Words of plain letters as the tokenizer's model wants them, and the ids that it gives them.

    The tokenizer is asked what it makes of every one of LETTERS and of all of them in one word. If
    that is the same, letter by letter, its model may be given words of them directly, which saves
    most of the work on a new word. Punctuation in front of or behind the letters is a word of its
    own; an apostrophe in front of letters is not, nor is what holds a special token.
    """

    def __init__(self, tokenizer):
        self.model, self._tokenizer = tokenizer.model, tokenizer
        try:
            seen = {c: self._seen(c) for c in LETTERS}
            fits = all(len(x) == 1 for x in seen.values()) and self._seen(LETTERS) == ["".join(x[0] for x in seen.values())]
            fits = fits and self._seen("ab,;é!(x") == [seen["a"][0] + seen["b"][0], ",;", seen["é"][0], "!(", seen["x"][0]]
        except Exception:  # noqa: BLE001 - a tokenizer without these parts is used as a whole
            fits = False
        self._specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._table = str.maketrans({c: x[0] for c, x in seen.items()}) if fits else None
        self._plain = fits and all(seen[c] == [c.lower()] for c in LETTERS if c.isascii())
        self._shape = rf"^(?P<before>[!-&(-/:-@\[-`{{-~]*)(?P<word>[{LETTERS}]+)(?P<behind>[!-/:-@\[-`{{-~]*)$"

    def _seen(self, text: str) -> list[str]:
        if self._tokenizer.normalizer:
            text = self._tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def bare(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are a word of ASCII letters alone: the usual case, told without a search."""
        return np.asarray(pc.ascii_is_alpha(pieces)) if self._plain else np.zeros(len(pieces), bool)

    def lower(self, pieces: pa.Array) -> pa.Array:
        return pc.ascii_lower(pieces) if self._plain else pieces

    def parts(self, pieces: pa.Array) -> pa.StructArray:
        """``before``, ``word`` and ``behind`` of each piece, or null if it has another shape."""
        if not self._table:
            return pa.nulls(len(pieces), pa.struct([(name, pa.string()) for name in ("before", "word", "behind")]))
        found = pc.extract_regex(self.lower(pieces), self._shape)
        for special in self._specials:
            found = pc.if_else(pc.match_substring(pieces, special), pa.scalar(None, found.type), found)
        return found

    def word_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if self._plain and word.isascii() else word.translate(self._table))]

    def marks_ids(self, marks: str) -> list[int]:
        return self._tokenizer.encode(marks, add_special_tokens=False).ids if marks else []


class PieceEncoder:
    """Encodes batches of texts; ``kind`` is ``word`` or ``byte``.

    Pieces met before are remembered by a number; their ids lie one after the other in one array.
    Of words between marks only the words and the marks are, so "Word", "word," and "(word" are one.
    """

    def __init__(self, path: str, kind: str, lengths_only: bool = False):
        self.path, self.kind, self.lengths_only = path, kind, lengths_only
        self._known: dict[str, int] = {}
        self._count, self._flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._again = np.zeros(0, bool)  # met in a later batch too
        mark = _tokenizer(path).encode(MARK, add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self._letters = _Letters(_tokenizer(path)) if kind == "word" else None

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of ``texts`` and where those of each text begin."""
        if self.kind == "word":
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            offsets = np.asarray(split.offsets, dtype=np.int64)
            return split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
        lists = [byte_pieces(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return pa.array([p for x in lists for p in x], pa.string()), offsets

    def _numbers(self, distinct: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The number of each distinct piece; new ones are encoded."""
        found = np.fromiter(map(self._known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        self._again[found[found >= 0]] = True
        if not len(new):
            return found
        pieces = [distinct[i] for i in new]
        ids = encode(pieces)
        begin, counts = len(self._count), np.fromiter(map(len, ids), np.int64, len(ids))
        self._count = np.concatenate((self._count, counts))
        self._again = np.concatenate((self._again, np.zeros(len(ids), bool)))
        if not self.lengths_only:
            self._flat = np.concatenate((self._flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))))
        found[new] = np.arange(begin, begin + len(new))
        self._known.update((p, begin + i) for i, p in enumerate(pieces) if len(p) <= CACHE_CHARS)
        return found

    def _forget(self) -> None:
        """Keep only the pieces of more than one batch since the last time, if they leave room, and number them anew."""
        keep = self._again
        if np.count_nonzero(keep) > CACHE_PIECES // 2:
            keep = np.zeros(len(keep), bool)
        if not self.lengths_only:
            self._flat = self._flat[_ranges((np.cumsum(self._count) - self._count)[keep], self._count[keep])]
        number = (np.cumsum(keep) - 1).tolist()
        self._known = {p: number[n] for p, n in self._known.items() if keep[n]}
        self._count = self._count[keep]
        self._again = np.zeros(len(self._count), bool)

    def _of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct pieces, put together from words and marks where they can be; counts and ids by number.

        What is put together has numbers of its own behind those remembered, for this batch only.
        """
        letters, made = self._letters, []
        bare = letters.bare(distinct)
        rest = np.flatnonzero(~bare)
        parts = letters.parts(distinct.take(rest))
        shaped = np.asarray(parts.is_valid())
        other, between = rest[~shaped], rest[shaped]
        parts = parts.filter(pa.array(shaped))
        words = letters.lower(distinct.filter(pa.array(bare)))
        words = pa.concat_arrays([words, parts.field("word")])
        for texts, encode in ((parts.field("before"), letters.marks_ids), (words, letters.word_ids), (parts.field("behind"), letters.marks_ids)):
            coded = texts.dictionary_encode()
            found = self._numbers(coded.dictionary.to_pylist(), lambda new, encode=encode: list(map(encode, new)))
            made.append(found[np.asarray(coded.indices)] if len(found) else np.zeros(0, np.int64))
        numbers = np.zeros(len(distinct), np.int64)
        numbers[other] = self._numbers(distinct.take(other).to_pylist(), self._fresh)
        numbers[bare], made[1] = made[1][: len(words) - len(between)], made[1][len(words) - len(between) :]
        made = np.stack(made, 1)
        counts, ids = self._count[made], self._flat
        whole = counts[:, 0] + counts[:, 2] == 0  # nothing but the word
        begin = len(self._count)
        numbers[between] = np.where(whole, made[:, 1], begin + np.cumsum(~whole) - 1)
        made, counts = made[~whole], counts[~whole]
        if not self.lengths_only:
            starts = (np.cumsum(self._count) - self._count)[made]
            ids = np.concatenate((ids, ids[_ranges(starts.ravel(), counts.ravel())]))
        return numbers, np.concatenate((self._count, counts.sum(axis=1))), ids

    def _fresh(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece.

        Words without the mark in them are encoded many at a time as one text with the mark between
        them, which is cheaper for the library and gives the same ids.
        """
        run = _tokenizer(self.path).encode_batch_fast
        if self.kind != "word" or self._mark is None:
            return [e.ids for at in range(0, len(pieces), 20_000) for e in run(pieces[at : at + 20_000], add_special_tokens=False)]
        out: list = [None] * len(pieces)
        joined = [i for i, piece in enumerate(pieces) if MARK not in piece]
        alone = [i for i, piece in enumerate(pieces) if MARK in piece]
        for at in range(0, len(joined), 20 * JOINED):
            groups = [joined[g : g + JOINED] for g in range(at, min(at + 20 * JOINED, len(joined)), JOINED)]
            texts = [f" {MARK} ".join([pieces[i] for i in group]) for group in groups]
            for group, found in zip(groups, run(texts, add_special_tokens=False)):
                begin, ids = 0, found.ids
                for i in group[:-1]:
                    end = ids.index(self._mark, begin)
                    out[i] = ids[begin:end]
                    begin = end + 1
                out[group[-1]] = ids[begin:]
        for at in range(0, len(alone), 5000):
            for i, found in zip(alone[at : at + 5000], run([pieces[i] for i in alone[at : at + 5000]], add_special_tokens=False)):
                out[i] = found.ids
        return out

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each piece of all texts, where those of each text begin, and counts and ids by number."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        pieces, offsets = self._pieces(texts)
        coded = pieces.dictionary_encode()
        if len(self._count) > CACHE_PIECES:
            self._forget()
        if self._letters:
            numbers, counts, ids = self._of_words(coded.dictionary)
        else:
            numbers = self._numbers(coded.dictionary.to_pylist(), self._fresh)
            counts, ids = self._count, self._flat
        index = numbers[np.asarray(coded.indices)] if len(numbers) else np.zeros(0, np.int64)
        return index, offsets, counts, ids

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        index, offsets, counts, _ = self._numbered(texts)
        ends = np.concatenate(([0], np.cumsum(counts[index])))
        return ends[offsets[1:]] - ends[offsets[:-1]]

    def ids(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the bounds of each; ``end_id`` ends every text."""
        index, offsets, each, flat = self._numbered(texts)
        counts = each[index]
        begins = (np.cumsum(each) - each)[index]
        ends = np.concatenate(([0], np.cumsum(counts)))
        bounds = ends[offsets]
        found = flat[_ranges(begins, counts)]
        if end_id is not None:
            found = np.insert(found, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return found, bounds


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    places = np.arange(int(ends[-1]) if len(ends) else 0)
    places += np.repeat(begins - ends + counts, counts)
    return places


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str, lengths_only: bool = False) -> PieceEncoder:
    """The encoder of this Python worker; it lives on from task to task."""
    key = (path, kind, lengths_only)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]

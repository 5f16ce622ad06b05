"""The patterns of ``functions.lexicon``, which are Java's, for Python's ``re``, and what else is read off texts."""

from __future__ import annotations

import re

from lumenscan.functions import lexicon as lx

# Where ``$`` holds: at the end, or in front of a last line break of any kind.
_END = r"(?=(?:\r\n|(?<!\r)\n|[\r\u0085\u2028\u2029])?+\Z)"
_SPACE = " \t\n\r\f\v"


def java(pattern: str) -> re.Pattern:
    """``pattern`` compiled; ``$`` is known at its end only.

    A long bracket looks for its end by stretches without ``]``, which takes the same text as a lazy search.
    """
    pattern = re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern)
    pattern = re.sub(r"\\k<(\w+)>", r"(?P=\1)", pattern).replace(r"\z", r"\Z")
    pattern = re.sub(r"\[\\s\\S\]\*\?\\\]\(\?P=(\w+)\)\\\]", r"[^\]]*+(?:\](?!(?P=\1)\])[^\]]*+)*+\](?P=\1)\]", pattern)
    if pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + _END
    return re.compile(pattern, re.ASCII)


_SPACES = re.compile(r"\s+", re.ASCII)
_LAST_SPACES, _FIRST_SPACES = java(r"\s+$"), java(r"^\s+")


def compact(text: str) -> str:
    """``functions.labels.compact``."""
    return _SPACES.sub(" ", text).strip(" ")


def strip(text: str) -> str:
    """``functions.labels.strip``."""
    return text.strip(_SPACE) if text.isascii() else _LAST_SPACES.sub("", _FIRST_SPACES.sub("", text))


def compact_ends(text: str) -> str:
    return text.strip(" ")


def without_spaces(text: str) -> str:
    return _SPACES.sub("", text)


def without_last_spaces(text: str) -> str:
    return text.rstrip(_SPACE) if text.isascii() else _LAST_SPACES.sub("", text)


# Lexers, with a group around the whole match in front of the others.
TOKENS, SCANNED = java(f"({lx.TOKEN_LEX})"), java(f"({lx.SCAN_LEX})")
FUNCTION_NAME = java(lx.FUNCTION_NAME)
SIMPLE_HEADER = java(lx.SIMPLE_HEADER)


def function_name(text: str) -> str:
    """The name in a function's lexeme, or an empty text."""
    found = FUNCTION_NAME.match(text)
    return without_spaces(found[lx.NAME_GROUP]) if found else ""


def header_text(text: str, sig_end: int) -> str:
    """``outline.header_text``."""
    if sig_end > 0:
        return compact(text[:sig_end])
    found = SIMPLE_HEADER.match(text)
    return compact(found[0]) if found else ""

"""Regular expressions that cut a source file into lexemes inside the JVM.

Two lexers share the same pieces:

* ``TOKEN_LEX`` cuts single tokens, for the token-level operators.
* ``SCAN_LEX`` cuts *scan lexemes*: function and block headers, block words, brackets
  that stay open on their line, and runs of everything else on one line.  A statement
  is one scan lexeme or two instead of ten tokens, so the sorts of the step pipeline
  handle a fraction of the rows.

In both, one match is a lexeme (group 1) plus the whitespace and comments behind it,
so the matches of a file concatenate to the file.  A file that starts with
whitespace or a comment gets an empty first lexeme.

Every repetition is possessive: a file is read once, and long files or unterminated
strings can neither backtrack nor recurse.
"""

from __future__ import annotations

NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
NUMBER = (
    r"0[xX][0-9a-fA-F_]++|0[bB][01_]++"
    r"|\d[\d_]*+(?:\.(?!\.)[\d_]*+)?+(?:[eE][+-]?\d[\d_]*+)?+"
)

# Words that open, close or shape a block; runs never contain them.
BLOCK_WORDS = (
    "function", "do", "then", "else", "elseif", "end", "repeat", "until",
    "if", "while", "for", "local", "return",
)
_BLOCK = "(?:" + "|".join(BLOCK_WORDS) + r")(?![A-Za-z0-9_])"
PLAIN_NAME = f"(?!{_BLOCK}){NAME}"


def quoted(q: str, closed: bool = False) -> str:
    """A quoted string; an unterminated one ends with its line.  ``\\z`` skips white space and line breaks."""
    return rf"{q}[^{q}\\\n]*+(?:\\(?:z\s*+|[\s\S])[^{q}\\\n]*+)*+" + (q if closed else rf"(?:{q}|(?=\n|\z))")


def interpolated(depth: int) -> str:
    """A backtick string with expressions in braces, which may hold strings of the same kind.

    One that is not closed on its line, or is nested more deeply than ``depth``, is cut as a
    plain quoted string.
    """
    plain = "|".join(quoted(q) for q in ('"', "'"))
    inner, braces = r"(?!)", r"(?!)"
    for _ in range(depth):
        braces = rf"\{{(?:[^`{{}}\"'\n]|{plain}|{inner}|{braces})*+\}}"
        inner = rf"`(?:[^`\\{{\n]|\\(?:z\s*+|[\s\S])|{braces})*+`"
        braces = r"(?!)"
    return inner


def long_bracket(group: str) -> str:
    """``[[...]]`` or ``[=[...]=]``; ``group`` names the back-reference."""
    return rf"\[(?<{group}>=*+)\[[\s\S]*?\]\k<{group}>\]"


STRING = "|".join([quoted('"'), quoted("'"), interpolated(2), quoted("`")])


# Stands for the levels that a piece of a text may leave open (``operators.pieces``).
LEVELS = "<LEVELS>"
# A long bracket that nothing closes in the piece, to the end of the piece.
LEFT_OPEN = rf"\[(?:{LEVELS})\[[\s\S]*+"


def comment(group: str, in_piece: bool = False) -> str:
    left_open = rf"|--{LEFT_OPEN}" if in_piece else ""
    return rf"--{long_bracket(group)}{left_open}|--[^\n]*+"


def trivia(group: str, in_piece: bool = False) -> str:
    return rf"(?:\s++|{comment(group, in_piece)})*+"


# Operators, longest first as the longest one wins (fixed values).
OPERATOR = (
    r"\.\.\.|\.\.=|//=|==|~=|<=|>=|\.\.|//|->|::|\+=|-=|\*=|/=|%=|\^=|<<|>>"
    r"|[+\-*/%^#&|~<>=:;,.?@]"
)

OPENERS = ("do", "then", "function", "repeat")
CLOSERS = ("end", "until", "elseif")
BRACKETS_OPEN = ("(", "[", "{")
BRACKETS_CLOSE = (")", "]", "}")

# What a lexeme is, as a small number: windows carry it through every pass.
KINDS = (
    "run", *OPENERS, *CLOSERS, "else", "if", "while", "for", ";", *BRACKETS_OPEN, *BRACKETS_CLOSE,
)

# Words coloured as keywords (fixed values).
KEYWORDS = (
    "and", "break", "do", "else", "elseif", "end", "false", "for", "function", "if",
    "in", "local", "nil", "not", "or", "repeat", "return", "then", "true", "until",
    "while", "continue", "type", "export", "typeof", "declare", "const", "class",
    "extends", "with", "extern", "read", "write",
)



def _token(in_piece: bool = False) -> str:
    left_open = f"|{LEFT_OPEN}" if in_piece else ""
    return rf"{NAME}|{NUMBER}|\.\d[\d_]*+|{STRING}|{long_bracket('t')}{left_open}|{OPERATOR}|\S"


def token_lex(in_piece: bool = False) -> str:
    return rf"(\A(?=\s|--)|{_token(in_piece)}){trivia('c', in_piece)}"


def raw_lex(in_piece: bool = False) -> str:
    """Lossless: whitespace and comments are matches of their own."""
    return rf"\s++|{comment('c', in_piece)}|{_token(in_piece)}"


TOKEN_LEX, RAW_LEX = token_lex(), raw_lex()

# What strings, comments and long brackets make of a piece; the head of one left open has a group of its own.
HEAD_GROUP = 3
OPEN_LEX = (
    rf"[^\"'`\[\-]++|{STRING}|{long_bracket('t')}|--{long_bracket('c')}|((?:--)?+\[(?:{LEVELS})\[)[\s\S]*+|--[^\n]*+|[\s\S]"
)
# A line break between two lines that no string, escape or run of white space goes across.
SAFE_BREAK = r"(?<=[^\s\\])(?<!\\z)\r?\n(?=\S)"
CLOSER = r"\](=*+)(?=\])"

# ---- scan lexemes -------------------------------------------------------------------

_OP_CHAR = r"(?!--)[^\s\w\"'`()\[\]{};]"
_ATOM = rf"{PLAIN_NAME}|{NUMBER}|{STRING}|{_OP_CHAR}"


def _nested(atom: str, depth: int, gap: str) -> str:
    """Brackets of any kind around atoms and brackets.  The pattern grows by one atom a level."""
    inner = r"(?!)"
    for _ in range(depth):
        inner = rf"[(\[{{](?:{gap}(?:{atom}|{inner}))*+{gap}[)\]}}]"
    return inner


_BLANK = r"[ \t]*+"
_G2 = _nested(_ATOM, 2, _BLANK)


def _piece(group: str) -> str:
    return rf"(?:{_ATOM}|{long_bracket(group)}|{_G2})"


# A run may begin with `local` or `return` but never contains one further on.
_LEAD = r"(?:local|return)(?![A-Za-z0-9_])"
# ``>`` in front of a bracket, unless of an arrow, may end the generic parameters of a header, so it is cut there.
_NO_TURN = r"(?!(?<!-)>\s*+(?:\(|--))"
RUN = rf"(?:{_LEAD}|{_NO_TURN}{_piece('t')})(?:{_BLANK}{_NO_TURN}{_piece('u')})*+"

# A function header that nests no deeper than code usually does is one lexeme, with its return type.
# Any other is cut open: one lexeme up to the bracket that opens it, and then what it holds.  There
# brackets are followed by their running depth instead of a pattern (``operators.headers``), so a
# header may nest and span as it likes.
_NO_WORD = r"(?![A-Za-z0-9_])"
DOTTED = rf"{NAME}(?:\s*+[.:]\s*+{NAME})*+"
_SHORT_GAP = r"(?:\s++|--(?!\[=*+\[)[^\n]*+)*+"
_HEADER_ATOM = rf"{PLAIN_NAME}|{NUMBER}|{quoted(chr(34))}|{quoted(chr(39))}|->|{_OP_CHAR}|;"
_PARAMS = rf"\((?:{_SHORT_GAP}(?:{_HEADER_ATOM}|{_nested(_HEADER_ATOM, 2, _SHORT_GAP)}))*+{_SHORT_GAP}\)"
SIMPLE_HEADER = rf"function{_NO_WORD}(?:\s++{DOTTED})?+\s*+(?:<[A-Za-z0-9_,. ]*+>\s*+)?+{_PARAMS}"
_RETURN_TYPE = rf"\s*+:(?!:)(?:{_BLANK}(?:{PLAIN_NAME}|{STRING}|->|[.?|&,<>]|{_G2}))*+"
# A return type that goes on with an open bracket is not simple.
_WHOLE_HEADER = rf"{SIMPLE_HEADER}(?:{_RETURN_TYPE}(?!{_BLANK}[(\[{{])|(?!\s*+:(?!:)))"


# Up to the bracket that opens the parameters, or the generic ones.
OPEN_HEADER = rf"function{_NO_WORD}(?:{trivia('oa')}{DOTTED})?+{trivia('ob')}[(<]"
# Comments in front of the name have a group of their own.
NAME_GROUP = 2
FUNCTION_NAME = rf"^function{_NO_WORD}{trivia('na')}({DOTTED}){trivia('nb')}[(<]"
# The end of generic parameters, and what opens the others.
_TURN = rf"(?<!-)>{trivia('p')}\("

# Block headers that fit on their line are one lexeme, from the keyword to `then` or `do`;
# others are cut at the keyword.  `until` takes its condition along.
_HEADERS = "|".join(
    rf"(?:{words}){_NO_WORD}(?:{_BLANK}{_piece(group)})++{_BLANK}{closing}{_NO_WORD}"
    for words, group, closing in (("if|elseif", "v", "then"), ("while|for", "w", "do"))
)
_UNTIL = rf"until{_NO_WORD}(?:{_BLANK}{_piece('x')})*+"

_SCAN = (
    rf"{_WHOLE_HEADER}|{OPEN_HEADER}|{_HEADERS}|{_UNTIL}|(?!local|return){_BLOCK}|{_TURN}|{RUN}"
    r"|[()\[\]{};]|\S"
)
SCAN_LEX = rf"(\A(?=\s|--)|{_SCAN}){trivia('c')}"

# An ``if`` behind one of these starts an expression, not a statement.
EXPRESSION_LEAD = r"(?:[=+\-*/%^#<>~,(\[{:.|&]|(?<![A-Za-z0-9_])(?:and|or|not|return))$"

"""Tokens with places.  Works on broken and on Python 2 source: what can't be read ends in an error token."""

from __future__ import annotations

import io
import tokenize
from typing import NamedTuple

LAYOUT = {tokenize.NEWLINE: "___NEWLINE___", tokenize.NL: "___NL___", tokenize.INDENT: "___INDENT___", tokenize.DEDENT: "___DEDENT___", tokenize.ENDMARKER: "___EOS___"}


class Token(NamedTuple):
    """Text of a token and its 0-based place, end column exclusive."""

    text: str
    sl: int
    sc: int
    el: int
    ec: int


def escaped(text: str) -> str:
    """Control characters of a token as escapes, so that a token is one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") if any(c in text for c in "\n\r\t") else text


def tokens(source: str) -> list[Token]:
    """All tokens, the end mark included.

    >>> [t.text for t in tokens("x = 1\\n")]
    ['x', '=', '1', '___NEWLINE___', '___EOS___']
    """
    out: list[Token] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.ENCODING:
                continue
            name = LAYOUT.get(t.type)
            out.append(Token(name or escaped(t.string), t.start[0] - 1, t.start[1], t.end[0] - 1, t.end[1]))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        line, col = (out[-1].el, out[-1].ec) if out else (0, 0)
        out += [Token("___ERROR___", line, col, line, col), Token("___EOS___", line, col, line, col)]
    return out


def program_tokens(source: str) -> list[Token]:
    """Tokens of a program: all but the last."""
    return tokens(source)[:-1]


def query_tokens(name: str) -> list[Token]:
    """Tokens of a query's name: all but the last."""
    return tokens(name)[:-1]


def header_tokens(header: str) -> list[Token]:
    """Tokens of a class header, which have no place."""
    return [Token(t.text, -1, -1, -1, -1) for t in tokens(header)]


def stub_tokens(source: str) -> list[Token]:
    """Tokens of a stub: columns hold the lines, as places in it mean nothing."""
    return [Token(t.text, t.sl, t.sl, t.el, t.el) for t in tokens(source)]

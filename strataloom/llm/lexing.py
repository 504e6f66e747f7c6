"""A lexer for source, configuration and Markdown texts of any language.

It knows what the families of languages share: strings in single, double and
back quotes with escapes, triple-quoted strings, prefixed and raw ones, comment
marks, words, operators and brackets, and block scalars of YAML.  Comments are
not skipped, since code stands in them too; only their marks are tokens of
their own.  A string keeps the place of its inside, quotes apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

WORD, STRING, BLOCK, OPERATOR, COMMENT, LINE = "word", "string", "block", "op", "comment", "line"


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    #: The inside of a string or block; the same as start and end for others.
    low: int
    high: int


_TOKEN = re.compile(
    r"""
      (?P<triple> (?:(?<![A-Za-z0-9_])[bBrRfFuU]{1,2})? (?P<mark>\"\"\"|''') (?P<held>(?:[^\\]|\\.)*?) (?P=mark) )
    | (?P<double> (?:(?<![A-Za-z0-9_])[bBrRfFuU@$]{1,2})? "(?P<in2>(?:[^"\\\n]|\\(?:\r\n|.))*+)" )
    | (?P<single> (?:(?<![A-Za-z0-9_])[bBrRfFuU]{1,2}|(?<![A-Za-z0-9])) '(?P<in1>(?:[^'\\\n]|\\(?:\r\n|.))*+)' )
    | (?P<back> `(?P<in0>(?:[^`\\]|\\.)*+)` )
    | (?P<comment> //+!? | \#+ | /\*+ | \*+/ | <!-- | --> )
    | (?P<word> [^\W\d][\w$]*+ (?:-[\w$]++)*+ | \$[\w$]++ )
    | (?P<line> \r?\n )
    | (?P<op> => | := | === | == | \?\?= | \|\|= | \\\r?\n | [-=:(),\[\]{}.+?<>|&*!;@%~^/\\] )
    | (?P<rest> [^\s\w"'`#/*<\-=:(),\[\]{}.+?>|&!;@%~^\\$]++ | \d[\w.]*+ | \S )
    """,
    re.X | re.S,
)
_BLOCK = re.compile(r"[ \t]*[|>][-+\d]{0,2}[ \t]*(?:\#[^\n]*)?\r?\n")
_INSIDE = {"triple": "held", "double": "in2", "single": "in1", "back": "in0"}


def tokens(text: str, low: int = 0, high: int | None = None) -> Iterator[Token]:
    """The tokens of a text, or of a part of it, in order."""
    high = len(text) if high is None else high
    at, search = low, _TOKEN.search
    while m := search(text, at, high):
        kind = m.lastgroup  # of nested groups the outer one closes last
        start, at = m.span()
        if kind in _INSIDE:
            yield Token(STRING, start, at, *m.span(_INSIDE[kind]))
            continue
        yield Token(kind, start, at, start, at)
        if kind == OPERATOR and text[start:at] == ":" and (b := _BLOCK.match(text, at, high)):
            body = _block(text, start, b.end(), high)
            if body:
                yield Token(BLOCK, at, body[1], *body)
                at = body[1]


def _block(text: str, at: int, begin: int, high: int) -> tuple[int, int] | None:
    """The inside of a block scalar: the lines indented deeper than the line of its name."""
    line = text.rfind("\n", 0, at) + 1
    own = len(text[line:at]) - len(text[line:at].lstrip(" -"))
    first = last = None
    while begin < high:
        end = text.find("\n", begin, high)
        end = high if end < 0 else end
        content = text[begin:end]
        bare = content.strip()
        if bare:
            if len(content) - len(content.lstrip(" ")) <= own:
                break
            if first is None:
                first = begin + content.index(bare[0])
            last = begin + len(content.rstrip())
        begin = end + 1
    return None if first is None else (first, last)

"""Token streams of Go and ECMAScript sources with matched brackets, for the extractors."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

# The reserved words of Go, those that begin a declaration, and those after which an ECMAScript slash begins a pattern.
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_DECLARES = frozenset(("func", "type", "const", "var", "import"))
_PATTERN_AFTER = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())

_GO_TOKEN = re.compile(r"(?P<space>[ \t\r]+|//[^\n]*)|(?P<line>\n)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?)|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<mark>\.\.\.|\+\+|--|.)", re.S)
_ECMA_TOKEN = re.compile(r"(?P<space>[^\S\n]+|//[^\n]*)|(?P<line>\n)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`)|(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<mark>\.\.\.|=>|\+\+|--|.)", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")


class Token(NamedTuple):
    kind: str  # name, number, text, mark
    text: str
    start: int
    end: int
    fresh: bool = False  # first on its line


class Source:
    """A text's tokens; ``other[i]`` is the partner of a bracket, or the last place before what must lie outside of one that isn't closed.

    No bracket reaches over a token in *restarts*.
    """

    def __init__(self, text: str, tokens: list[Token], restarts: frozenset[int] = frozenset()):
        self.text, self.tokens, self.balanced = text, tokens, True
        self._lines = [m.start() for m in re.finditer("\n", text)]
        self.other: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(tokens):
            if i in restarts:
                self.other |= dict.fromkeys(open_, i - 1)
                open_.clear()
            if t.kind != "mark":
                continue
            if t.text in "([{":
                open_.append(i)
            elif t.text in ")]}":
                wanted = {")": "(", "]": "[", "}": "{"}[t.text]
                if not any(tokens[o].text == wanted for o in open_):
                    self.balanced = False
                    continue
                while tokens[open_[-1]].text != wanted:
                    self.balanced = False
                    self.other[open_.pop()] = i - 1
                self.other[i] = open_.pop()
                self.other[self.other[i]] = i
        self.balanced = self.balanced and not open_
        self.other |= dict.fromkeys(open_, len(tokens))

    def line(self, i: int) -> int:
        """The line of a token, of the last one for the number of tokens."""
        t = self.tokens[min(i, len(self.tokens) - 1)]
        return bisect.bisect_left(self._lines, t.end - 1) + 1 if t.text else bisect.bisect_left(self._lines, t.start) + 1

    def first_line(self, i: int) -> int:
        return bisect.bisect_left(self._lines, self.tokens[i].start) + 1

    def is_(self, i: int, mark: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text == mark and self.tokens[i].kind in ("mark", "name")

    def after(self, i: int) -> int:
        """The place behind a token, behind its partner for an opening bracket."""
        return self.other[i] + 1 if self.tokens[i].kind == "mark" and self.tokens[i].text in "([{" else i + 1

    def part(self, start: int, end: int) -> str:
        """The text of tokens [start, end) in one line."""
        end = min(end, len(self.tokens))
        return " ".join(self.text[self.tokens[start].start : self.tokens[end - 1].end].split()) if start < end else ""

    def split(self, start: int, end: int, mark: str = ";") -> list[tuple[int, int]]:
        """The stretches of [start, end) between marks that stand in no bracket."""
        out, i, begin, end = [], start, start, min(end, len(self.tokens))
        while i < end:
            if self.is_(i, mark):
                if begin < i:
                    out.append((begin, i))
                begin = i + 1
            i = self.after(i)
        if begin < end:
            out.append((begin, end))
        return out


def go_source(text: str) -> Source:
    """Go tokens with the semicolons that line ends insert."""
    out: list[Token] = []
    for m in _GO_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "line" or kind == "block" and "\n" in m.group():
            last = out[-1] if out else None
            if last and (last.kind in ("text", "number") or last.kind == "name" and (last.text not in GO_WORDS or last.text in ("break", "continue", "fallthrough", "return")) or last.text in (")", "]", "}", "++", "--")):
                out.append(Token("mark", ";", m.start(), m.start()))
        elif kind not in ("space", "block"):
            out.append(Token(kind, m.group(), m.start(), m.end()))
    src = Source(text, out)
    first = [i for i, t in enumerate(out) if i and t.kind == "name" and t.text in _GO_DECLARES and text[t.start - 1] == "\n"]
    if src.balanced and all(out[i - 1].text == ";" or out[i].text == "func" for i in first):
        return src
    again: list[Token] = []  # in a broken text, declarations begin anew at the first column
    restarts = set()
    begins = set(first)
    for i, t in enumerate(out):
        if i in begins:
            restarts.add(len(again))
            again.append(Token("mark", ";", t.start, t.start))
        again.append(t)
    return Source(text, again, frozenset(restarts))


def ecma_source(text: str) -> Source:
    """ECMAScript tokens; a template is one token with all that stands in it."""
    out: list[Token] = []
    at, fresh = 0, True
    while at < len(text):
        m = _ECMA_TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "line" or kind == "block" and "\n" in m.group():
            fresh = True
        elif kind not in ("space", "block"):
            last = out[-1] if out else None
            if kind == "template":
                kind, end = "text", _template_end(text, at + 1)
            elif m.group() == "/" and (last is None or last.kind == "mark" and last.text not in (")", "]", "}", "++", "--") or last.kind == "name" and last.text in _PATTERN_AFTER) and (p := _PATTERN.match(text, at)):
                kind, end = "text", p.end()
            out.append(Token(kind, text[at:end], at, end, fresh))
            fresh = False
        at = end
    return Source(text, out)


def _template_end(text: str, at: int) -> int:
    """The end of a template whose inside begins at *at*; it may hold expressions with texts and templates."""
    inside: list[int] = []  # open braces of each expression around
    while at < len(text):
        c = text[at]
        if inside and inside[-1] >= 0:  # in an expression
            if c in "\"'" and (m := re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, at)):
                at = m.end()
                continue
            if c == "{":
                inside[-1] += 1
            elif c == "}":
                inside[-1] -= 1
                if inside[-1] < 0:
                    inside.pop()
            elif c == "`":
                inside.append(-1)
        elif c == "\\":
            at += 1
        elif c == "$" and text[at + 1 : at + 2] == "{":
            inside.append(0)
            at += 1
        elif c == "`":
            if not inside:
                return at + 1
            inside.pop()
        at += 1
    return len(text)

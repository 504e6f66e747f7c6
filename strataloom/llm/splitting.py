"""Cutting texts over a token limit into pieces, at natural boundaries.

Recursive bisection: a span over the limit (less the overlap) is cut at the
strongest boundary in its middle half, the nearest to the midpoint among equally
strong ones; both halves go on the same way.  Then each piece but the first
gets the last tokens before it as overlap.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._texts import per_row

#: The part of a span, on either side of its midpoint, in which a boundary is sought.
MIDDLE = 0.25

# All blank lines in a row; begun behind a line's last character only, so that long runs of blanks are read once.
_BLANK_LINES = r"(?<=\S)[^\S\n]*+\n(?:[^\S\n]*+\n)++"
# Boundaries by strength; the cut lies at the end of the match.
_BOUNDARIES = [
    (9, re.compile(_BLANK_LINES + r"(?=#{1,2} |\S[^\n]*+\n(?:=++|-++)[^\S\n]*+\n)")),  # a chapter of a Markdown text
    (8, re.compile(_BLANK_LINES + r"(?=(?:#{3,6} |(?:async\s+)?def |class |func |type |export |(?:async\s+)?function |CREATE |\[|@\w))")),  # sections, top-level definitions
    (7, re.compile(r"\n[ \t]*\r?\n(?=\S)")),  # a blank line before a line without indent
    (6, re.compile(r"\n[ \t]*\r?\n")),  # any blank line
    (5, re.compile(r"\r\n|\n|\r")),  # a line end
    (4, re.compile(r"[.!?。！？][\"')\]]*\s+")),  # a sentence end
    (3, re.compile(r"[;{}]\s*|,\s+|:\s+")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"[,;)\]}/&|=+-]")),
]


class Piece(NamedTuple):
    start: int  # of the piece with its overlap
    core: int  # where the piece goes on after the overlap
    end: int
    n_tokens: int


class Boundaries:
    """The ends of all boundaries of a text, by strength; each strength is looked up in the whole text once, when asked for."""

    def __init__(self, text: str):
        self.text = text
        self.ends: list[list[int]] = []

    def strongest(self, low: int, high: int) -> list[int]:
        """Places of the strongest kind of boundary from *low* to *high*."""
        for i, (_, pattern) in enumerate(_BOUNDARIES):
            if i == len(self.ends):
                self.ends.append([m.end() for m in pattern.finditer(self.text)])
            ends = self.ends[i]
            first = bisect.bisect_left(ends, low)
            last = bisect.bisect_right(ends, high, first)
            if last > first:
                return ends[first:last]
        return []


#: A table of more languages' limits isn't taken as one.
MOST_LIMITS = 10_000


def split(text: str, max_tokens: int, overlap_tokens: int, path: str) -> list[Piece]:
    """Pieces of a text, none over *max_tokens* tokens; one piece if it fits.

    The pieces without their overlaps join to the text.  An overlap is never
    longer than the piece before it, and shorter than asked only where a limit
    leaves no room for it.
    """
    encode = tokens.encoding(path).encode_ordinary
    ids = encode(text)
    if len(ids) <= max_tokens:
        return [Piece(0, 0, len(text), len(ids))] if text else []
    limit = max(1, max_tokens)
    overlap = max(0, min(overlap_tokens, limit - 1))
    cap = limit - overlap
    offsets = tokens.starts(text, ids, path)
    boundaries = Boundaries(text)
    # tokens before a character; several tokens may start within one character
    place = lambda char: bisect.bisect_left(offsets, char)

    def cut_of(start: int, end: int) -> int:
        a, b = place(start), place(end)
        middle = (a + b) / 2
        low = offsets[min(int(a + (b - a) * MIDDLE), len(offsets) - 1)]
        high = offsets[min(int(b - (b - a) * MIDDLE), len(offsets) - 1)]
        found = boundaries.strongest(max(low, start + 1), min(high, end - 1))
        if found:
            return min(found, key=lambda p: (abs(place(p) - middle), p))
        p = offsets[min(int(middle), len(offsets) - 1)]
        return p if start < p < end else (start + end) // 2

    def cores(start: int, end: int) -> list[tuple[int, int]]:
        out, todo = [], [(start, end)]
        while todo:
            s, e = todo.pop()
            if e - s <= 1 or place(e) - place(s) <= cap:
                out.append((s, e))
                continue
            c = cut_of(s, e)
            todo += [(c, e), (s, c)]
        return out

    out: list[Piece] = []
    todo = cores(0, len(text))[::-1]
    while todo:
        s, e = todo.pop()
        begin = s
        if out and overlap:
            begin = max(out[-1].start, offsets[max(0, place(s) - overlap)])
        n = len(encode(text[begin:e]))  # alone it may take a few tokens more than within the text
        if n > limit and e - s > 1:
            c = cut_of(s, e)
            todo += [(c, e), (s, c)]
            continue
        while n > limit and begin < s:
            # leave out so many tokens of the overlap as are over, one at least
            begin = min(s, max(begin + 1, offsets[min(place(begin) + n - limit, len(offsets) - 1)]))
            n = len(encode(text[begin:e]))
        out.append(Piece(begin, s, e, n))
    return out


def pieces(documents: DataFrame, limits: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", lang: str | Column = "lang", tokenizer_path: str | None = None, keep_short: bool = False) -> DataFrame:
    """(doc_id, piece, start, core_start, end, n_tokens, text) of texts over their language's limit.

    limits: (lang, max_tokens, overlap_tokens), one row per language, at most
    MOST_LIMITS; of repeated languages the lowest limit counts; ``default`` holds for
    languages without a row and for null.  Texts
    within the limit give no rows, or one with *keep_short*.  Null and empty
    texts give none.  A single character of more tokens than the limit is a
    piece of its own.  Without a default a language without a row has no limit.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    path = tokenizer_path or tokens.default_path()
    rows = limits.where(F.col("max_tokens").isNotNull()).select("lang", "max_tokens", "overlap_tokens").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"limits of more than {MOST_LIMITS} languages")
    table = {r.lang: (r.max_tokens, r.overlap_tokens or 0) for r in sorted(rows, key=lambda r: (r.max_tokens, r.overlap_tokens or 0), reverse=True)}
    docs = documents.select(as_col(doc_id).alias("doc_id"), as_col(lang).alias("lang"), as_col(text).alias("text")).where(F.col("text").isNotNull())

    def cut_up(key, language, body):
        most, overlap = table.get(language) or table.get("default") or (None, 0)
        if not body or (not keep_short and most is not None and len(body.encode("utf-8", "surrogatepass")) <= most):
            return  # a token is a byte at least
        if most is None:
            found = [Piece(0, 0, len(body), tokens.count(body, path))]
        else:
            found = split(body, most, overlap, path)
        if len(found) > 1 or keep_short:
            for i, p in enumerate(found):
                yield key, i, p.start, p.core, p.end, p.n_tokens, body[p.start : p.end]

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return per_row(docs, cut_up, f"doc_id {key_type}, piece bigint, start bigint, core_start bigint, end bigint, n_tokens bigint, text string")

"""Semantic code indexes in protobuf wire form: documents, symbols and occurrences, without generated classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .rows import flat_map


class WireError(ValueError):
    pass


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message; truncated and unknown forms fail."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= n or shift > 63:
                raise WireError("varint")
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < n:
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, kind, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            if at + size > n:
                raise WireError("truncated")
            yield number, kind, raw[at : at + size]
            at += size
        else:
            raise WireError(f"wire type {kind}")


def packed(value: int | bytes, kind: int) -> list[int]:
    """Repeated integers, packed or single."""
    if kind == 0:
        return [value]
    out, at = [], 0
    while at < len(value):
        v = shift = 0
        while True:
            if at >= len(value):
                raise WireError("packed")
            b = value[at]
            at += 1
            v |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        out.append(v)
    return out


def display_name(symbol: str) -> str:
    """The last descriptor of a symbol, without its suffix marks."""
    if symbol.startswith("local "):
        return symbol[6:]
    import re

    parts = re.findall(r"`([^`]+)`|([\w$+-]+)", symbol.rsplit(" ", 1)[-1])
    return next((a or b for a, b in reversed(parts)), symbol)


def _range(r: list[int]) -> tuple[int, int, int, int]:
    """Zero-based (start line, start character, end line, end character) of three or four numbers."""
    if len(r) == 3:
        return r[0], r[1], r[0], r[2]
    if len(r) == 4:
        return r[0], r[1], r[2], r[3]
    raise WireError("range")


def read_index(raw: bytes):
    """(path, language, record, symbol, roles, start_line, start_column, end_line, end_column, documentation) of an index.

    record: occurrence or symbol; lines from 1, columns from 0.
    """
    for number, kind, doc in fields(raw):
        if number != 2 or kind != 2:
            continue
        path = language = ""
        rows = []
        for f, k, v in fields(doc):
            if f == 1 and k == 2:
                path = v.decode()
            elif f == 4 and k == 2:
                language = v.decode()
            elif f == 2 and k == 2:
                spot: list[int] = []
                symbol, roles = "", 0
                for g, w, x in fields(v):
                    if g == 1:
                        spot += packed(x, w)
                    elif g == 2 and w == 2:
                        symbol = x.decode()
                    elif g == 3:
                        roles = x
                a, b, c, d = _range(spot)
                rows.append(("occurrence", symbol, roles, a + 1, b, c + 1, d, None))
            elif f == 3 and k == 2:
                symbol, said = "", []
                for g, w, x in fields(v):
                    if g == 1 and w == 2:
                        symbol = x.decode()
                    elif g == 3 and w == 2:
                        said.append(x.decode())
                rows.append(("symbol", symbol, None, None, None, None, None, "\n".join(said)))
        for r in rows:
            yield path, language, *r


def index_table(files: DataFrame) -> DataFrame:
    """files: (content binary). A malformed index fails its task."""
    return flat_map(files.select("content"), lambda raw: read_index(bytes(raw or b"")), "path string, language string, record string, symbol string, roles bigint, start_line bigint, start_column bigint, end_line bigint, end_column bigint, documentation string")


def byte_offset(line: str, column: int, unit: str) -> int:
    """The byte offset of a column counted in utf-8, utf-16 or utf-32 units; beyond the line its end."""
    if unit == "utf-8":
        return min(column, len(line.encode()))
    used = at = 0
    for c in line:
        if used >= column:
            break
        used += 2 if unit == "utf-16" and ord(c) > 0xFFFF else 1
        at += len(c.encode())
    return at

"""Markdown: headings as a section tree, and relative links."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import flat_map

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"\[[^\]\n]*\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)")
_SCHEME = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)")


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.strip().lower()).strip("-")


def plain(text: str) -> str:
    return text.translate({ord(c): None for c in "`*_#"}).strip()


def _setext(line: str) -> int:
    bare = line.strip()
    return 0 if not bare or set(bare) not in ({"="}, {"-"}) else 1 if bare[0] == "=" else 2


def headings(text: str) -> list[tuple[int, int, str, int]]:
    """(ordinal, level, title, line) outside fenced code."""
    out, fence, before = [], "", ""
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if m := _FENCE.match(line):
            if not fence:
                fence = m.group(1)[:3]
            elif m.group(1).startswith(fence):
                fence = ""
            before = ""
            continue
        if fence:
            continue
        if m := _ATX.match(line):
            out.append((len(m.group(1)), plain(m.group(2) or ""), number))
            before = ""
        elif before and (level := _setext(line)):
            out.append((level, plain(before), number - 1))
            before = ""
        else:
            before = line.strip() if line[:1] not in (" ", "\t", ">", "-", "*", "|") else ""
    return [(i, level, title, at) for i, (level, title, at) in enumerate(out)]


def sections(doc_id, text: str | None):
    """(doc_id, ordinal, level, heading, anchor, parent, start_line, end_line) of one document."""
    found = headings(text or "")
    lines = len((text or "").splitlines())
    used: dict[str, int] = {}
    open_: list[tuple[int, int]] = []
    for k, (i, level, title, at) in enumerate(found):
        while open_ and open_[-1][0] >= level:
            open_.pop()
        base = slug(title) or "section"
        used[base] = used.get(base, 0) + 1
        end = found[k + 1][3] - 1 if k + 1 < len(found) else max(lines, at)
        yield doc_id, i, level, title, base if used[base] == 1 else f"{base}-{used[base]}", open_[-1][1] if open_ else None, at, end
        open_.append((level, i))


def resolve(path: str, target: str) -> str | None:
    """A relative link as a path in the tree; None if it leads out of it or isn't relative."""
    bare = re.split(r"[?#]", target, maxsplit=1)[0]
    if not bare or _SCHEME.match(target):
        return None
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(path), bare) if not bare.startswith("/") else bare.lstrip("/"))
    return None if joined.startswith("..") or joined in (".", "") else joined


def links(doc_id, path: str | None, text: str | None):
    for number, line in enumerate((text or "").split("\n"), 1):
        for m in _LINK.finditer(line):
            if (where := resolve(path or "", m.group(1))) is not None:
                yield doc_id, number, where


def section_table(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", "text"), sections, f"doc_id {key}, ordinal bigint, level bigint, heading string, anchor string, parent bigint, start_line bigint, end_line bigint")


def link_table(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(doc_id, line, artifact_id) of links to listed files. docs: (doc_id, snapshot_id, path, text); artifacts: (snapshot_id, path, artifact_id)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    found = flat_map(docs.select("doc_id", "path", "text"), links, f"doc_id {key}, line bigint, target string")
    there = found.join(docs.select("doc_id", "snapshot_id"), "doc_id")
    listed = artifacts.select("snapshot_id", F.col("path").alias("target"), "artifact_id")
    return there.join(listed, ["snapshot_id", "target"]).select("doc_id", "line", "artifact_id")

"""Extractors by language and capability, run over the files they are for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.tree import detect_language
from . import code, manifests, markdown

# What an extractor can give.
CAPABILITIES = ("symbols", "sections", "manifests", "links", "findings", "diagnostics")


class Extractor(NamedTuple):
    name: str
    version: str
    capability: str
    languages: tuple[str, ...]  # empty: all
    run: Callable[[DataFrame], DataFrame]
    most_rows: int = 0  # 0: no limit on what it may emit


class LimitError(RuntimeError):
    """An extractor gave more than it may."""


class Registry:
    def __init__(self, extractors: tuple[Extractor, ...] = ()):
        self._by_name: dict[str, Extractor] = {}
        for e in extractors:
            self.add(e)

    def add(self, e: Extractor) -> None:
        if e.capability not in CAPABILITIES:
            raise ValueError(f"capability {e.capability!r}")
        if e.name in self._by_name:
            raise ValueError(f"extractor {e.name!r} is there already")
        self._by_name[e.name] = e

    def select(self, capability: str, language: str | None = None) -> list[Extractor]:
        """By name; those for all languages serve every language."""
        return [e for _, e in sorted(self._by_name.items()) if e.capability == capability and (language is None or not e.languages or language in e.languages)]

    def run(self, capability: str, files: DataFrame) -> DataFrame | None:
        """The rows of all extractors of a capability with ``extractor``. files: (doc_id, path, text, ...)."""
        parts = []
        for e in self.select(capability):
            own = files.where(detect_language(F.col("path")).isin(*e.languages)) if e.languages else files
            rows = e.run(own)
            if e.most_rows and rows.limit(e.most_rows + 1).count() > e.most_rows:
                raise LimitError(e.name)
            parts.append(rows.withColumn("extractor", F.lit(f"{e.name}@{e.version}")))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def builtin() -> Registry:
    return Registry(
        (
            Extractor("python", "1", "symbols", ("python",), code.python_table),
            Extractor("go", "1", "symbols", ("go",), code.go_table),
            Extractor("ecma", "1", "symbols", ("javascript", "typescript"), code.ecma_table),
            Extractor("markdown", "1", "sections", ("markdown",), markdown.section_table),
            Extractor("manifests", "1", "manifests", (), manifests.manifest_table),
        )
    )

"""Findings of a small pattern table, and literals taken out of all strings of a record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract.rows import flat_map

# Kind, pattern with the literal as group 1, confidence.
PATTERNS = (
    ("token", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", 0.99),
    ("api_key", r"(?i)\bapi[_-]?key[\"']?\s*[:=]\s*[\"']([^\"'\s]{12,})[\"']", 0.9),
    ("password", r"(?i)\bpass(?:word|wd)[\"']?\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']", 0.8),
    ("private_key", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[\s\S]+?-----END (?:[A-Z]+ )?PRIVATE KEY-----)", 0.99),
)
HIGH = 0.90


def _found(doc_id, text: str | None):
    import hashlib

    for kind, pattern, confidence in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            a, b = m.span(1)
            raw = (text or "").encode("utf-8", "surrogatepass")
            start = len((text or "")[:a].encode("utf-8", "surrogatepass"))
            size = len(m.group(1).encode("utf-8", "surrogatepass"))
            yield doc_id, kind, confidence, hashlib.sha256(raw[start : start + size]).hexdigest()[:16], start, start + size, (text or "").count("\n", 0, a) + 1, (text or "").count("\n", 0, b) + 1


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, confidence, fingerprint, start_byte, end_byte, start_line, end_line). docs: (doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", "text"), _found, f"doc_id {key}, kind string, confidence double, fingerprint string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint")


def without_literals(literals: list[str], mark: str = "<redacted>"):
    """A function on column batches that replaces the literals, the longest first. The list is small: it comes from one bundle."""
    ordered = sorted({x for x in literals if x}, key=lambda x: (-len(x), x))
    pattern = re.compile("|".join(map(re.escape, ordered))) if ordered else None

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s if pattern is None else s.map(lambda v: v if v is None else pattern.sub(mark, v))

    return clean


def redact_record(df: DataFrame, literals: list[str], columns: list[str], maps: list[str] = ()) -> DataFrame:
    """Literals out of string columns and of keys and values of maps; keys that fall together get #2, #3 ...

    Columns not named stay as they are.
    """
    clean = without_literals(literals)
    out = df.withColumns({c: clean(F.col(c)) for c in columns})
    for m in maps:
        entries = F.array_sort(F.map_entries(m))  # so that which key gets a number doesn't depend on the map's order
        keys, values = F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"])
        # arrays pass through one string each, joined by a mark that no literal holds
        plain = lambda a: F.split(clean(F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit(""))), "\x1f")), "\x1f")
        out = out.withColumn("_k", plain(keys)).withColumn("_v", plain(values)).withColumn(m, F.when(F.size(m) > 0, F.map_from_arrays(_distinct_keys(F.col("_k")), F.col("_v"))).otherwise(F.col(m))).drop("_k", "_v")
    return out


def _distinct_keys(keys: Column) -> Column:
    def name(k: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(keys, F.lit(1), i), lambda x: x == k))
        return F.when(before > 0, F.concat(k, F.lit("#"), (before + 1).cast("string"))).otherwise(k)

    return F.transform(keys, name)

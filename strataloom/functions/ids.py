"""Stable ids, content ids and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(namespace: str, *parts: Column, prefix: str = "rec") -> Column:
    """prefix:namespace:24 hex digits of the SHA-256 of namespace and parts, joined by NUL; null parts count as ''."""
    nul = F.char(F.lit(0))
    joined = F.concat(F.lit(namespace), nul, F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]) if parts else F.lit(""))
    return F.concat(F.lit(f"{prefix}:{namespace}:"), F.substring(F.sha2(joined, 256), 1, 24))


def content_id(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def row_digest(*cols: Column) -> Column:
    """SHA-256 over a canonical encoding of a row: lengths and values, null apart from ''."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *map(part, cols)), 256)


def set_digest(digests: Column) -> Column:
    """An order-insensitive digest of a group of row digests: sum of their leading 60 bits, and their number.

    One partial aggregation; no row of the group is gathered anywhere.
    """
    bits = F.conv(F.substring(digests, 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws("/", F.sum(bits).cast("string"), F.count("*").cast("string")), 256)

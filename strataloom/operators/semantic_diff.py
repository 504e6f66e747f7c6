"""Two-snapshot comparison with severities: keyed full outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import SEVERITY_RANKS, is_public, mapped, normal_resolution
from .coverage import one_row

# Compared fields in output order.
ARTIFACT_FIELDS = {"content": "sha256", "status": "status", "language": "language", "media_type": "media_type", "generated": "generated", "vendored": "vendored"}
NODE_FIELDS = {"name": "name", "qualified_name": "qualified_name", "signature": "signature", "visibility": "visibility", "public_surface": "public_surface", "artifact": "artifact_id", "semantic_hash": "semantic_hash"}
EDGE_FIELDS = {"resolution": "resolution", "confidence": "confidence", "producer": "producer"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _keyed(df: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """One row per key: the last by seq."""
    order = [F.col("seq")] if "seq" in df.columns else []
    return df.select(key.alias("key"), F.struct(*order, *fields).alias("row")).groupBy("key").agg(F.max("row").alias("row"))


def _compare(before: DataFrame, after: DataFrame, key: Column, fields: dict[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
    held = list(dict.fromkeys([*fields.values(), *extra]))
    old = _keyed(before, key, held).withColumnRenamed("row", "old")
    new = _keyed(after, key, held).withColumnRenamed("row", "new")
    met = old.join(new, "key", "full_outer")
    changed = F.array_compact(F.array(*[F.when(_text(F.col(f"old.{c}")) != _text(F.col(f"new.{c}")), F.lit(name)) for name, c in fields.items()]))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("changed") > 0, "modified")
    out = met.withColumn("changed", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    return out.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull())


def diff_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change_kind, changed) by path."""
    return _compare(before, after, F.col("path"), ARTIFACT_FIELDS).select("key", "change_kind", "changed")


def node_key() -> Column:
    filled = lambda c: F.when(_text(F.col(c)) != "", F.col(c))
    named = F.when(filled("qualified_name").isNotNull(), F.concat_ws("\x00", _text(F.col("language")), _text(F.col("kind")), F.col("qualified_name")))
    return F.coalesce(filled("logical_id"), named, F.col("id"))


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change_kind, changed, severity, reasons): severity breaking, risk or info."""
    d = _compare(before, after, node_key(), NODE_FIELDS)
    was = is_public(F.col("old.public_surface"), F.col("old.visibility"))
    now = is_public(F.col("new.public_surface"), F.col("new.visibility"))
    modified, has = F.col("change_kind") == "modified", lambda f: F.array_contains("changed", f)
    removed = (F.col("change_kind") == "removed") & was
    signature, hidden = modified & was & has("signature"), modified & was & ~now
    breaking = removed | signature | hidden
    renamed = modified & has("qualified_name") & ~breaking
    inner = modified & has("semantic_hash") & ~breaking & ~renamed
    reasons = F.array_compact(
        F.array(
            F.when(removed, "public symbol removed"),
            F.when(signature, "public signature changed"),
            F.when(hidden, "public symbol became non-public"),
            F.when(renamed, "logical name changed"),
            F.when(inner, "implementation semantics changed"),
        )
    )
    severity = F.when(breaking, "breaking").when(renamed | inner, "risk").otherwise("info")
    return d.select("key", "change_kind", "changed", severity.alias("severity"), reasons.alias("reasons"))


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change_kind, changed) by kind, from and to; resolutions compare without aliases."""
    plain = lambda df: df.withColumn("resolution", normal_resolution("resolution"))
    return _compare(plain(before), plain(after), F.concat_ws("\x00", "kind", "from", "to"), EDGE_FIELDS).select("key", "change_kind", "changed")


def ordered_nodes(diff: DataFrame) -> DataFrame:
    """Worst first, then by key."""
    return diff.orderBy(mapped(F.col("severity"), SEVERITY_RANKS, 0).desc(), "key")


def summary(artifacts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of eleven counters."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[F.count_if(F.col("change_kind") == k).alias(f"{name}_{k}") for k in ("added", "removed", "modified")])

    worst = nodes.agg(F.count_if(F.col("severity") == "breaking").alias("breaking"), F.count_if(F.col("severity") == "risk").alias("risk"))
    return one_row(counts(artifacts, "artifacts"), counts(nodes, "nodes"), counts(edges, "edges"), worst)

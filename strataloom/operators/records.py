"""Filtered, paginated record queries."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocabulary import RESOLUTIONS, normal_resolution

# Page sizes and limits of the query surfaces.
PAGE_DEFAULT, PAGE_MOST = 50, 200
LIMIT_DEFAULT, LIMIT_MOST = 50, 1000


def page_size(n: int | None) -> int:
    return PAGE_DEFAULT if not n or n <= 0 else min(n, PAGE_MOST)


def clamp_limit(n: int | None) -> int:
    return LIMIT_DEFAULT if not n or n <= 0 else min(n, LIMIT_MOST)


def where_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal in all given columns; None and '' are wildcards. A null field never equals."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def filter_nodes(nodes: DataFrame, kind: str | None = None, language: str | None = None, artifact_id: str | None = None, visibility: str | None = None) -> DataFrame:
    return where_equal(nodes, kind=kind, language=language, artifact_id=artifact_id, visibility=visibility)


def filter_edges(edges: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None, resolution: str | None = None) -> DataFrame:
    """Edges (id, kind, from, to, resolution) by equality; an unknown resolution is an error."""
    out = where_equal(edges, **{"kind": kind, "from": source, "to": target})
    if resolution:
        wanted = {"resolved": "compiler_resolved", "observed": "runtime_observed", "syntax-inferred": "syntax_inferred", "runtime-observed": "runtime_observed"}.get(resolution.strip().lower(), resolution.strip().lower())
        if wanted not in RESOLUTIONS:
            raise ValueError(f"unknown resolution {resolution!r}")
        out = out.where(normal_resolution("resolution") == wanted)
    return out


def filter_diagnostics(diagnostics: DataFrame, severity: str | None = None, code: str | None = None, stage: str | None = None) -> DataFrame:
    return where_equal(diagnostics, severity=severity, code=code, stage=stage)


def filter_artifacts(artifacts: DataFrame, language: str | None = None, status: str | None = None, path_prefix: str | None = None) -> DataFrame:
    out = where_equal(artifacts, language=language, status=status)
    return out.where(F.col("path").startswith(path_prefix)) if path_prefix else out


def keyset_page(df: DataFrame, id_col: str, after: str | None = None, size: int | None = None) -> tuple[DataFrame, int]:
    """Rows with ids beyond the cursor, in order of id; one more than the page's size, to tell whether it is the last.

    The plan is a filter and a top-k, so no page sorts the table.
    """
    n = page_size(size)
    out = df if after in (None, "") else df.where(F.col(id_col) > after)
    return out.orderBy(id_col).limit(n + 1), n


def time_page(df: DataFrame, time_col: str, id_col: str, before: tuple | None = None, size: int | None = None) -> tuple[DataFrame, int]:
    """Newest first, then by id; the cursor is the (time, id) of the last row seen. Rows without a time come last."""
    n = page_size(size)
    if before is not None:
        t, i = before
        df = df.where((F.col(time_col) < F.lit(t)) | ((F.col(time_col) == F.lit(t)) & (F.col(id_col) > i)) | F.col(time_col).isNull())
    return df.orderBy(F.col(time_col).desc_nulls_last(), id_col).limit(n + 1), n


class CursorError(ValueError):
    """A cursor that was changed, or made for another query."""


def scope_of(*parts: str) -> str:
    """A fingerprint of a query's filters; lengths keep neighbouring parts apart."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()


def encode_cursor(key: bytes, scope: str, position: dict) -> str:
    """A signed cursor: base64 of its JSON, a dot, and base64 of the HMAC."""
    body = json.dumps({"v": 1, "s": scope, "p": position}, sort_keys=True, separators=(",", ":")).encode()
    sign = hmac.new(key, body, hashlib.sha256).digest()
    pack = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return f"{pack(body)}.{pack(sign)}"


def decode_cursor(key: bytes, scope: str, cursor: str) -> dict:
    try:
        body, sign = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in cursor.split("."))
        if not hmac.compare_digest(sign, hmac.new(key, body, hashlib.sha256).digest()):
            raise CursorError("signature")
        held = json.loads(body)
    except (ValueError, TypeError) as e:
        raise CursorError(str(e)) from None
    if held.get("v") != 1 or held.get("s") != scope:
        raise CursorError("scope")
    return held["p"]


def resolve_reference(nodes: DataFrame, reference: str) -> tuple[str, str | None]:
    """(state, id): the node with this id, else the only one with this logical id, qualified name or name.

    state: found, not_found or ambiguous.
    """
    by_name = (F.col("logical_id") == reference) | (F.col("qualified_name") == reference) | (F.col("name") == reference)
    rank = F.when(F.col("id") == reference, 0).otherwise(1)
    rows = nodes.where((F.col("id") == reference) | by_name).select("id", rank.alias("r")).distinct().orderBy("r", "id").limit(2).collect()
    if not rows:
        return "not_found", None
    if rows[0].r == 0 or len(rows) == 1:
        return "found", rows[0].id
    return "ambiguous", None


def facets(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(facet, value, n): languages that aren't empty, node kinds, edge resolutions, severities."""
    one = lambda df, facet, col: df.groupBy(col.alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    return (
        one(artifacts.where(F.coalesce("language", F.lit("")) != ""), "language", F.col("language"))
        .unionByName(one(nodes, "node_kind", F.col("kind")))
        .unionByName(one(edges, "edge_resolution", normal_resolution("resolution")))
        .unionByName(one(diagnostics, "severity", F.col("severity")))
    )

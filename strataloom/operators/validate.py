"""Integrity rules over a bundle of record families: one DataFrame of violations.

Each rule yields (code, severity, subject); identical violations collapse.
Families may be missing; their rules are then left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import (
    ARTIFACT_KINDS,
    ARTIFACT_STATUSES,
    CERTAINTIES,
    CLAIM_STATES,
    DOCUMENT_STATUSES,
    EDGE_KINDS,
    EVIDENCE_KINDS,
    NODE_KINDS,
    RESOLUTIONS,
    SEVERITIES,
    normal_resolution,
)

_HEX = r"^[0-9a-fA-F]{64}$"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def _when(df: DataFrame, bad: Column, code: str, severity: str = "error", subject: str = "id") -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.coalesce(F.col(subject).cast("string"), F.lit("")).alias("subject"))


def _repeated(df: DataFrame, code: str) -> DataFrame:
    twice = df.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return _when(twice, F.lit(True), code)


def _missing(df: DataFrame, ref: str, there: DataFrame, code: str, severity: str = "error") -> DataFrame:
    """Rows whose reference, if any, isn't among the ids."""
    asked = df.select("id", F.col(ref).alias("_ref")).where(~_blank(ref) if ref in df.columns else F.lit(True))
    lost = asked.join(there.select(F.col("id").alias("_ref")).distinct(), "_ref", "left_anti")
    return _when(lost, F.lit(True), code, severity)


def _missing_each(df: DataFrame, refs: str, there: DataFrame, code: str, severity: str = "error") -> DataFrame:
    return _missing(df.select("id", F.explode(refs).alias("_one")).withColumnRenamed("_one", "each"), "each", there, code, severity)


def _outside(c: str, values: list[str]) -> Column:
    return ~F.coalesce(F.col(c), F.lit("")).isin(*values)


def _unit(c: str) -> Column:
    v = F.col(c)
    return v.isNull() | F.isnan(v) | (v < 0) | (v > 1)


def _range(prefix: str = "") -> Column:
    """A source range that can't be: lines below 1, columns below 0, or an end before its start."""
    s, e, a, b = (F.col(prefix + c) for c in ("start_line", "end_line", "start_column", "end_column"))
    return (s < 1) | (e < 1) | (a < 0) | (b < 0) | (e < s) | ((e == s) & (b < a))


def violations(families: dict[str, DataFrame]) -> DataFrame:
    """(code, severity, subject), distinct, over the families given.

    artifacts (id, path, kind, status, size_bytes, sha256), nodes (id, kind,
    name, artifact_id, evidence_ids, start_line, end_line), edges (id, kind,
    from, to, resolution, confidence, evidence_ids), evidence (id, kind,
    confidence), diagnostics (id, severity, code, artifact_id), claims (id,
    subject_id, text, certainty, validation, evidence_ids), conflicts (id,
    subject_id, candidate_ids, preferred_id), documents (id, path, status,
    subject_ids, content_sha256), sections (id, document_id, parent_id), paths
    (id, node_ids, edge_ids, entry_node_id, exit_node_id).
    """
    out: list[DataFrame] = []
    g = families.get
    for name, df in families.items():
        one = name[:-1] if name.endswith("s") else name
        out += [_repeated(df, f"DUPLICATE_{one.upper()}_ID"), _when(df, _blank("id"), f"EMPTY_{one.upper()}_ID")]
    a, n, e, ev = g("artifacts"), g("nodes"), g("edges"), g("evidence")
    if a is not None:
        out += [
            _when(a, _blank("path"), "EMPTY_ARTIFACT_PATH"),
            _when(a, F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "UNSAFE_ARTIFACT_PATH"),
            _when(a, _outside("kind", ARTIFACT_KINDS), "UNKNOWN_ARTIFACT_KIND"),
            _when(a, _outside("status", ARTIFACT_STATUSES), "UNKNOWN_ARTIFACT_STATUS"),
            _when(a, F.col("size_bytes") < 0, "NEGATIVE_ARTIFACT_SIZE"),
            _when(a, ~_blank("sha256") & ~F.col("sha256").rlike(_HEX), "BAD_ARTIFACT_DIGEST"),
            _when(a.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("path", "id"), F.lit(True), "DUPLICATE_ARTIFACT_PATH"),
        ]
    if n is not None:
        out += [_when(n, _outside("kind", NODE_KINDS), "UNKNOWN_NODE_KIND"), _when(n, _blank("name"), "EMPTY_NODE_NAME")]
        out += [_when(n, _range(), "BAD_NODE_RANGE")] if {"start_column", "end_column"} <= set(n.columns) else [_when(n, (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "BAD_NODE_RANGE")]
        if a is not None:
            out.append(_missing(n, "artifact_id", a, "NODE_ARTIFACT_MISSING"))
        if ev is not None:
            out += [_missing_each(n, "evidence_ids", ev, "NODE_EVIDENCE_MISSING"), _when(n, F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0, "NODE_WITHOUT_EVIDENCE", "warning")]
    if e is not None:
        out += [_when(e, _outside("kind", EDGE_KINDS), "UNKNOWN_EDGE_KIND"), _when(e, ~F.coalesce(normal_resolution("resolution"), F.lit("")).isin(*RESOLUTIONS), "UNKNOWN_RESOLUTION"), _when(e, _unit("confidence"), "BAD_EDGE_CONFIDENCE")]
        if n is not None:
            out += [_missing(e, "from", n, "EDGE_SOURCE_MISSING"), _missing(e, "to", n, "EDGE_TARGET_MISSING"), _when(e, _blank("from") | _blank("to"), "EMPTY_EDGE_END")]
        if ev is not None:
            out += [_missing_each(e, "evidence_ids", ev, "EDGE_EVIDENCE_MISSING"), _when(e, F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0, "EDGE_WITHOUT_EVIDENCE", "warning")]
    if ev is not None:
        out += [_when(ev, _outside("kind", EVIDENCE_KINDS), "UNKNOWN_EVIDENCE_KIND"), _when(ev, _unit("confidence"), "BAD_EVIDENCE_CONFIDENCE")]
    if (d := g("diagnostics")) is not None:
        out += [_when(d, _outside("severity", SEVERITIES), "UNKNOWN_SEVERITY"), _when(d, _blank("code"), "EMPTY_DIAGNOSTIC_CODE")]
        if a is not None:
            out.append(_missing(d, "artifact_id", a, "DIAGNOSTIC_ARTIFACT_MISSING"))
    known = [x.select("id") for x in (n, a, g("claims")) if x is not None]
    subjects = reduce(lambda x, y: x.unionByName(y), known) if known else None
    if (c := g("claims")) is not None:
        out += [_when(c, _blank("text"), "EMPTY_CLAIM"), _when(c, _outside("validation", CLAIM_STATES), "UNKNOWN_CLAIM_STATE"), _when(c, _outside("certainty", CERTAINTIES), "UNKNOWN_CERTAINTY"), _missing(c, "subject_id", subjects, "CLAIM_SUBJECT_MISSING")]
        out += [_missing_each(c, "evidence_ids", ev, "CLAIM_EVIDENCE_MISSING")] if ev is not None else []
    if (x := g("conflicts")) is not None:
        out += [
            _when(x, F.size(F.array_distinct(F.coalesce("candidate_ids", F.array().cast("array<string>")))) < 2, "CONFLICT_TOO_FEW_CANDIDATES"),
            _when(x, ~_blank("preferred_id") & ~F.array_contains("candidate_ids", F.col("preferred_id")), "CONFLICT_PREFERRED_UNKNOWN"),
        ]
        out += [_missing_each(x, "candidate_ids", subjects, "CONFLICT_CANDIDATE_MISSING"), _missing(x, "subject_id", subjects, "CONFLICT_SUBJECT_MISSING")] if subjects is not None else []
    if (doc := g("documents")) is not None:
        out += [_when(doc, _blank("path"), "EMPTY_DOCUMENT_PATH"), _when(doc, _outside("status", DOCUMENT_STATUSES), "UNKNOWN_DOCUMENT_STATUS"), _when(doc, ~_blank("content_sha256") & ~F.col("content_sha256").rlike(_HEX), "BAD_DOCUMENT_DIGEST")]
        out += [_missing_each(doc, "subject_ids", subjects, "DOCUMENT_SUBJECT_MISSING")] if subjects is not None else []
    if (s := g("sections")) is not None:
        parents = s.select("id") if n is None else s.select("id").unionByName(n.select("id"))
        out.append(_missing(s, "parent_id", parents, "SECTION_PARENT_MISSING"))
        out += [_missing(s, "document_id", doc, "SECTION_DOCUMENT_MISSING")] if doc is not None else []
    if (p := g("paths")) is not None:
        out.append(_when(p, (F.size("node_ids") == 0) | (F.size("edge_ids") != F.size("node_ids") - 1), "BAD_PATH_SHAPE"))
        out.append(_when(p, (F.element_at("node_ids", 1) != F.col("entry_node_id")) | (F.element_at("node_ids", -1) != F.col("exit_node_id")), "BAD_PATH_ENDS"))
        if e is not None:
            out.append(broken_paths(p, e))
    return reduce(lambda x, y: x.unionByName(y), out).distinct()


def broken_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths whose edges don't connect their consecutive nodes: a join on edge ids, not a search per edge."""
    hops = paths.where(F.size("edge_ids") == F.size("node_ids") - 1).select("id", "node_ids", F.posexplode("edge_ids").alias("at", "edge"))
    hops = hops.select("id", "edge", F.element_at("node_ids", F.col("at") + 1).alias("a"), F.element_at("node_ids", F.col("at") + 2).alias("b"))
    met = hops.join(edges.select(F.col("id").alias("edge"), "from", "to"), "edge", "left")
    joined = ((F.col("from") == F.col("a")) & (F.col("to") == F.col("b"))) | ((F.col("from") == F.col("b")) & (F.col("to") == F.col("a")))
    return _when(met, ~F.coalesce(joined, F.lit(False)), "PATH_EDGE_DISCONNECTED").distinct()

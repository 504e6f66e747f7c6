"""Coverage counts, ratios and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import is_public, is_resolved, is_symbol

# Which statuses count as what.
INELIGIBLE = ("excluded", "inventory_only", "oversized", "unsupported", "redacted", "unreadable")
EXCLUDED = INELIGIBLE[:5]
PARSED = ("parsed", "syntax_parsed", "semantic_parsed")


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 1 of nothing."""
    return F.when(d == 0, F.lit(1.0)).otherwise(n / d)


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    """One row. artifacts: (status, text boolean, semantic boolean)."""
    status, text = F.trim(F.coalesce("status", F.lit(""))), F.coalesce("text", F.lit(False))
    return artifacts.agg(
        F.count("*").alias("artifacts_encountered"),
        F.count("*").alias("artifacts_inventoried"),
        _n(text).alias("text_artifacts"),
        _n(text & ~status.isin(*INELIGIBLE)).alias("eligible"),
        _n(status.isin(*PARSED)).alias("syntactically_parsed"),
        _n((status == "semantic_parsed") | F.coalesce("semantic", F.lit(False))).alias("semantically_parsed"),
        _n(status.isin(*EXCLUDED)).alias("excluded"),
        _n(status == "binary").alias("binary"),
        _n(status == "unreadable").alias("unreadable"),
    )


def node_counts(nodes: DataFrame, documented: DataFrame) -> DataFrame:
    """One row. nodes: (id, kind, visibility, public_surface, evidence_ids, documentation, confidence, confidence_class); documented: ids with a document that holds."""
    public = is_public(F.col("public_surface"), F.col("visibility"))
    symbol = is_symbol("kind")
    secret = F.col("kind") == "secret"
    told = F.coalesce(F.col("has_document"), F.lit(False)) | (F.trim(F.coalesce("documentation", F.lit(""))) != "")
    high = (F.coalesce("confidence", F.lit(0.0)) >= 0.90) | (F.coalesce("confidence_class", F.lit("")) == "high")
    flagged = nodes.join(documented.select("id").distinct().withColumn("has_document", F.lit(True)), "id", "left")
    return flagged.agg(
        F.count("*").alias("nodes_total"),
        _n(symbol).alias("symbols_total"),
        _n(symbol & (F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0)).alias("symbols_with_evidence"),
        _n(symbol & public).alias("public_symbols"),
        _n(symbol & public & told).alias("public_symbols_documented"),
        _n(secret).alias("secret_findings"),
        _n(secret & high).alias("high_confidence_secrets"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    yes = F.coalesce(is_resolved("resolution"), F.lit(False))
    return edges.agg(F.count("*").alias("edges_total"), _n(yes).alias("resolved_edges"), _n(~yes).alias("unresolved_edges"))


def claim_counts(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count("*").alias("claims_total"), _n(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0).alias("claims_with_evidence"))


def one_row(*rows: DataFrame) -> DataFrame:
    """Rows of different tables, one each, side by side: united, and each column's only value kept."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return united.agg(*[F.max(c).alias(c) for c in united.columns])


def documented_subjects(documents: DataFrame) -> DataFrame:
    """Ids that a document speaks of which is neither rejected nor stale. documents: (status, subject_ids)."""
    return documents.where(~F.coalesce(F.col("status"), F.lit("")).isin("rejected", "stale")).select(F.explode("subject_ids").alias("id")).distinct()


def coverage(artifacts: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame, documents: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row of counts and ratios. Each table is read once, with partial aggregation; 0 of 0 is 1."""
    row = one_row(artifact_counts(artifacts), node_counts(nodes, documented_subjects(documents)), edge_counts(edges), claim_counts(claims), conflicts.agg(F.count("*").alias("conflicts_total")))
    c = F.col
    return row.withColumns(
        {
            "inventory_ratio": ratio(c("artifacts_inventoried"), c("artifacts_encountered")),
            "syntactic_ratio": ratio(c("syntactically_parsed"), c("eligible")),
            "semantic_ratio": ratio(c("semantically_parsed"), c("eligible")),
            "symbol_evidence_ratio": ratio(c("symbols_with_evidence"), c("symbols_total")),
            "public_documentation_ratio": ratio(c("public_symbols_documented"), c("public_symbols")),
            "edge_resolution_ratio": ratio(c("resolved_edges"), c("edges_total")),
            "claim_citation_ratio": ratio(c("claims_with_evidence"), c("claims_total")),
        }
    )


def count_map(df: DataFrame, col: str, trim: bool = False) -> DataFrame:
    """One row with the map of values to counts; the values are a closed vocabulary."""
    key = F.trim(F.coalesce(col, F.lit(""))) if trim else F.coalesce(col, F.lit(""))
    counts = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


# The gates' defaults; -1 turns a gate off.
GATES = {"inventory": 1.0, "symbol_evidence": 1.0, "edge_resolution": 0.0, "claim_citation": 1.0, "syntactic": 0.0, "semantic": 0.0, "public_documentation": -1.0, "errors": 0, "fatal": 0, "unresolved": -1, "secrets": 0}


def quality_gates(row: DataFrame, diagnostics: DataFrame, digest: Column | None = None, **limits: float) -> DataFrame:
    """(failures): the sorted names of the gates that fail, for a row of ``coverage``."""
    g = {**GATES, **limits}
    by = diagnostics.agg(_n(F.col("severity") == "error").alias("n_errors"), _n(F.col("severity") == "fatal").alias("n_fatal"))
    c = F.col
    least = lambda name, floor, guard=None: F.when((F.lit(True) if guard is None else guard > 0) & F.lit(floor >= 0) & (c(f"{name}_ratio") + 1e-12 < floor), name)
    most = lambda name, col, cap: F.when(F.lit(cap >= 0) & (c(col) > cap), name)
    checks = [
        least("inventory", g["inventory"]),
        least("syntactic", g["syntactic"], c("text_artifacts")),
        least("semantic", g["semantic"], c("text_artifacts")),
        least("symbol_evidence", g["symbol_evidence"], c("symbols_total")),
        least("public_documentation", g["public_documentation"], c("public_symbols")),
        least("edge_resolution", g["edge_resolution"], c("edges_total")),
        least("claim_citation", g["claim_citation"], c("claims_total")),
        most("errors", "n_errors", g["errors"]),
        most("fatal", "n_fatal", g["fatal"]),
        most("unresolved", "unresolved_edges", g["unresolved"]),
        most("secrets", "high_confidence_secrets", g["secrets"]),
        F.when(F.coalesce(digest, F.lit("")) == "", "digest") if digest is not None else F.lit(None).cast("string"),
    ]
    return one_row(row, by).select(F.array_sort(F.array_compact(F.array(*checks))).alias("failures"))

"""Controlled vocabularies, aliases and ranks as plain values and column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds, states and aliases that records may have.
NODE_KINDS = (
    "repository project package directory file symlink special archive archive_member notebook notebook_cell module namespace class interface trait type enum enum_member function method constructor field property variable constant "
    "parameter return_value api_service api_endpoint api_operation security_scheme graphql_type graphql_field rpc_service rpc_method cli_command cli_argument cli_flag config_key environment_variable secret database database_table "
    "database_column database_view database_index migration schema message event topic queue build_target deployment container_image test test_suite fixture document document_section external_dependency license owner execution_path unresolved_symbol"
).split()
EDGE_KINDS = (
    "contains declares imports exports references calls instantiates inherits implements overrides aliases reads writes mutates validates serializes deserializes exposes routes_to handles authenticates authorizes tests covers documents "
    "configures depends_on builds generates packages deploys emits subscribes publishes consumes migrates invoked_by supersedes owned_by licensed_under observed_with derived_from related_to"
).split()
ARTIFACT_KINDS = "file directory symlink special archive archive_member notebook notebook_cell manifest source document binary generated vendored".split()
ARTIFACT_STATUSES = "recorded included text parsed syntax_parsed semantic_parsed excluded inventory_only binary vendored generated redacted unreadable unsupported oversized".split()
EVIDENCE_KINDS = "declared compiler_resolved syntax_inferred runtime_observed documentation_asserted model_inferred manifest build_metadata test_result coverage security_scan user_asserted".split()
SEVERITIES = "note warning error fatal".split()
DOCUMENT_STATUSES = "draft validated rejected published stale".split()
CLAIM_STATES = "pending accepted rejected inference stale".split()
CERTAINTIES = "supported inferred uncertain contradicted".split()
SNAPSHOT_STATUSES = "building validating committed failed superseded".split()
RESOLUTIONS = "declared compiler_resolved syntax_inferred runtime_observed documentation_asserted model_inferred unresolved".split()
RESOLUTION_ALIASES = {"resolved": "compiler_resolved", "observed": "runtime_observed", "syntax-inferred": "syntax_inferred", "runtime-observed": "runtime_observed"}
RESOLVED = ("declared", "compiler_resolved", "runtime_observed")
SYMBOL_KINDS = (
    "module namespace package class interface trait type enum enum_member function method constructor field property variable constant parameter test api_service api_endpoint api_operation security_scheme rpc_service rpc_method "
    "cli_command cli_argument cli_flag config_key environment_variable database_table database_column database_view schema message event topic queue build_target deployment"
).split()
STATUS_RANKS = {"semantic_parsed": 5, "syntax_parsed": 4, "parsed": 4, "text": 3, "recorded": 2, "included": 2}
RESOLUTION_RANKS = {"compiler_resolved": 7, "runtime_observed": 6, "declared": 5, "syntax_inferred": 4, "documentation_asserted": 3, "model_inferred": 2}
SEVERITY_RANKS = {"breaking": 3, "risk": 2, "info": 1}


def mapped(col: Column, values: dict, other: object) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def normal_resolution(col: Column | str) -> Column:
    c = F.trim(F.lower(F.col(col) if isinstance(col, str) else col))
    return mapped(c, RESOLUTION_ALIASES, c)


def is_resolved(col: Column | str) -> Column:
    return normal_resolution(col).isin(*RESOLVED)


def is_symbol(kind: Column | str) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(*SYMBOL_KINDS)


def is_public(public_surface: Column, visibility: Column) -> Column:
    return F.coalesce(public_surface.cast("boolean"), F.lit(False)) | F.coalesce(visibility.isin("public", "exported"), F.lit(False))


def status_rank(col: Column) -> Column:
    return mapped(col, STATUS_RANKS, 1)


def resolution_rank(col: Column) -> Column:
    return mapped(normal_resolution(col), RESOLUTION_RANKS, 1)

"""Reading record families: schemas are given, unknown shapes fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

SOURCE = "struct<artifact_id:string,path:string,start_byte:bigint,end_byte:bigint,start_line:int,start_column:int,end_line:int,end_column:int,anchor:string>"
#: The record families and their columns.
FAMILIES = {
    "artifacts": "id string, logical_id string, content_id string, path string, kind string, language string, media_type string, size_bytes bigint, sha256 string, line_count int, text boolean, status string, exclusion_reason string, license_expression string, attributes map<string,string>",
    "nodes": f"id string, logical_id string, kind string, name string, qualified_name string, signature string, language string, visibility string, public_surface boolean, artifact_id string, source {SOURCE}, semantic_hash string, evidence_ids array<string>, attributes map<string,string>",
    "edges": "id string, kind string, `from` string, `to` string, resolution string, confidence double, producer string, evidence_ids array<string>, attributes map<string,string>",
    "evidence": f"id string, kind string, method string, confidence double, source {SOURCE}, tool string, observed_at timestamp, detail string",
    "diagnostics": f"id string, severity string, code string, message string, source {SOURCE}, stage string, plugin string",
    "conflicts": "id string, kind string, subject_id string, candidate_ids array<string>, preferred_id string, evidence_ids array<string>",
    "claims": "id string, subject_id string, text string, category string, certainty string, validation string, evidence_ids array<string>",
    "documents": "id string, kind string, title string, path string, subject_ids array<string>, status string, content_sha256 string, sections array<struct<id:string,parent_id:string,ordinal:int,heading:string,markdown:string,plain_text:string>>",
    "paths": "id string, name string, entry_node_id string, exit_node_id string, node_ids array<string>, edge_ids array<string>",
}


def schema_of(family: str) -> StructType:
    return _parse_datatype_string(FAMILIES[family])


def read_jsonl(spark: SparkSession, path: str, family: str) -> DataFrame:
    """JSON lines of one family; a malformed record fails the read."""
    return spark.read.schema(schema_of(family)).json(path, mode="FAILFAST")


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All families of an exported folder."""
    return {f: read_jsonl(spark, f"{folder}/{f}.jsonl", f) for f in FAMILIES}


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The records of a run journal, with the digest of each record's own content recomputed as ``digest``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    kind = "run_id string, sequence bigint, event string, at timestamp, previous_digest string, payload string, record_digest string"
    rows = raw.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.withColumn("digest", journal_digest())


def journal_digest() -> Column:
    """The digest of a journal record: run, sequence, event, time, previous digest and payload."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\x00", *map(text, ("run_id", "sequence", "event", "at", "previous_digest", "payload"))), 256)

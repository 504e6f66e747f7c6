"""Evidence packets: a bounded one-hop closure of records for a question, and the checks of answers built on it."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import induced

# Sizes of packets and answers.
EDGES_MOST, RELATED_MOST, EVIDENCE_MOST, HITS_MOST, NODES_MOST = 64, 24, 64, 32, 24
EXCERPT_BYTES, EXCERPTS_BYTES = 8 << 10, 64 << 10
CLAIM_RUNES, REPAIRS_MOST = 2000, 2


class Packet(NamedTuple):
    nodes: DataFrame  # (id, ...)
    edges: DataFrame
    evidence: DataFrame
    truncated: DataFrame  # one row of counts of what was left out


def _counts(spark, **parts: tuple[DataFrame, int]) -> DataFrame:
    rows = [(name, max(0, df.count() - most)) for name, (df, most) in parts.items()]
    return spark.createDataFrame(rows, "part string, left_out bigint")


def one_hop(subject: str, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> Packet:
    """The subject, its first edges by (kind, from, to, id), their other ends by id, and the evidence of all of them by id.

    Edges to nodes that don't fit are dropped. nodes, edges: with evidence_ids.
    """
    near = cut(edges.where((F.col("from") == subject) | (F.col("to") == subject)))
    some = near.orderBy("kind", "from", "to", "id").limit(EDGES_MOST)
    other = some.select(F.when(F.col("from") == subject, F.col("to")).otherwise(F.col("from")).alias("id")).where(F.col("id") != subject).distinct()
    related = cut(nodes.join(other, "id", "left_semi"))
    kept = related.orderBy("id").limit(RELATED_MOST)
    all_nodes = cut(nodes.where(F.col("id") == subject).unionByName(kept))
    all_edges = cut(induced(some, all_nodes))
    wanted = all_nodes.select(F.explode("evidence_ids").alias("id")).unionByName(all_edges.select(F.explode("evidence_ids").alias("id"))).distinct()
    found = cut(evidence.join(wanted, "id", "left_semi"))
    return Packet(all_nodes, all_edges, found.orderBy("id").limit(EVIDENCE_MOST), _counts(nodes.sparkSession, edges=(near, EDGES_MOST), nodes=(related, RELATED_MOST), evidence=(found, EVIDENCE_MOST)))


def hit_nodes(hits: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(rank, id): the nodes that hits stand for: the node itself, an artifact's nodes, a document's subjects. hits: (rank, id)."""
    direct = hits.join(nodes.select("id"), "id").select("rank", "id")
    of_artifact = hits.select("rank", F.col("id").alias("artifact_id")).join(nodes.select("id", "artifact_id"), "artifact_id").select("rank", "id")
    subjects = documents.select(F.col("id").alias("doc"), F.explode("subject_ids").alias("id"))
    of_document = hits.select("rank", F.col("id").alias("doc")).join(subjects, "doc").select("rank", "id")
    return direct.unionByName(of_artifact).unionByName(of_document).groupBy("id").agg(F.min("rank").alias("rank"))


def from_hits(hits: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, documents: DataFrame) -> Packet:
    """Context of the best hits: their nodes in hit order, the edges among them, the evidence of both."""
    best = hits.where(F.col("rank") <= HITS_MOST)
    ranked = hit_nodes(best, nodes, documents).join(nodes, "id")
    kept = ranked.orderBy("rank", "id").limit(NODES_MOST)
    among = induced(edges, kept)
    some = among.orderBy("kind", "from", "to", "id").limit(EDGES_MOST)
    wanted = kept.select(F.explode("evidence_ids").alias("id")).unionByName(some.select(F.explode("evidence_ids").alias("id"))).distinct()
    found = evidence.join(wanted, "id", "left_semi")
    return Packet(kept.drop("rank"), some, found.orderBy("id").limit(EVIDENCE_MOST), _counts(nodes.sparkSession, nodes=(ranked, NODES_MOST), edges=(among, EDGES_MOST), evidence=(found, EVIDENCE_MOST)))


def evidence_of(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, place, evidence_id, kind): the evidence of nodes in its own order."""
    placed = nodes.select("id", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    return placed.join(evidence.select(F.col("id").alias("evidence_id"), "kind"), "evidence_id").select("id", "place", "evidence_id", "kind").orderBy("id", "place")


def excerpts(rows: DataFrame, group: str, order: str, text: str, most: int = EXCERPT_BYTES, total: int = EXCERPTS_BYTES) -> DataFrame:
    """Texts of a group cut to *most* bytes each and to what the budget leaves; exhausted ones are left out."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    shorter = lambda n: F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, F.lit(1), n - k)), F.decode(F.substring(raw, F.lit(1), n - k), "UTF-8")) for k in range(4)], F.lit(""))
    size = F.least(F.octet_length(raw), F.lit(most))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = rows.withColumn("_size", size).withColumn("_room", F.least(F.col("_size"), F.greatest(F.lit(total) - before, F.lit(0))))
    return sized.where((F.col("_room") > 0) | (F.col("_size") == 0)).withColumn(text, shorter(F.col("_room"))).drop("_size", "_room")


# --- Claims --------------------------------------------------------------------

_MARKUP = re.compile(r"(?i)<\s*(?:script|iframe|object|embed|style|link|meta)\b|javascript:|data:text/html|on\w+\s*=")
_CODE = re.compile(r"`([^`\n]+)`")


def claim_problems(text: str, citations: list[str], packet_ids: set[str], known_names: set[str], certainty: str = "supported", category: str = "fact") -> list[str]:
    """Why a claim can't stand: emptiness, length, markup, several sentences, bad citations, unknown identifiers."""
    out = []
    if not text.strip():
        out.append("empty")
    if len(text) > CLAIM_RUNES:
        out.append("too_long")
    if _MARKUP.search(text):
        out.append("unsafe_markup")
    bare = _CODE.sub("x", text.strip())
    if re.search(r"[.!?]\s+[A-Z0-9`]", bare) or "\n\n" in text:
        out.append("not_atomic")
    if category not in ("fact", "behavior", "structure", "risk", "inference"):
        out.append("unknown_category")
    if certainty not in ("supported", "inferred", "uncertain"):
        out.append("unknown_certainty")
    if not citations:
        out.append("uncited")
    if len(set(citations)) < len(citations):
        out.append("repeated_citation")
    out += [f"foreign_citation:{c}" for c in citations if c not in packet_ids]
    out += [f"unknown_identifier:{n}" for n in _CODE.findall(text) if n not in known_names]
    return out


class Answer(NamedTuple):
    answered: bool
    claims: list[str]
    gaps: list[str]
    attempts: int


def answer(question: str, retrieve: Callable[[list[str]], list], ground: Callable[[str, list], tuple[bool, list[str], list[str], list[str]]], most: int = REPAIRS_MOST) -> Answer:
    """Retrieve, ground, and repair at most *most* times; the best attempt has most claims, then fewest gaps, then an answer.

    *ground* returns (answered, claims, gaps, follow-up queries).  Without hits there is nothing to ground.
    """
    from .retrieval import repair_queries

    queries, tries = [question], []
    for _ in range(most + 1):
        hits = retrieve(queries)
        if not hits:
            tries.append((False, [], ["insufficient_evidence"], []))
            break
        tries.append(ground(question, hits))
        more = repair_queries(tries[-1][3])
        if not tries[-1][2] or not more:
            break
        queries = [question, *more]
    best = max(tries, key=lambda t: (len(t[1]), -len(t[2]), t[0]))
    return Answer(best[0] and bool(best[1]), best[1], best[2], len(tries))


def usage(runs: DataFrame) -> DataFrame:
    """One row of token totals (held at the largest long instead of overflowing) and the peak memory. runs: (prompt, generated, peak)."""
    most = F.lit(2**63 - 1)
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), most.cast("decimal(38,0)")).cast("bigint")
    return runs.agg(F.coalesce(total("prompt"), F.lit(0)).alias("prompt"), F.coalesce(total("generated"), F.lit(0)).alias("generated"), F.max("peak").alias("peak"))

"""The record families as views of the data folder's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import EdgeIndex
from ..operators.retrieval import FULLTEXT_BOOSTS
from ..operators.search_index import LexicalIndex, VectorIndex
from ..session import ensure_checkpoint_dir
from ..sources.tables import bare, latest, table


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """The valid row of each artifact of each snapshot."""
    a = table(spark, folder, "artifacts").withColumn("snapshot_id", bare("snapshot_id"))
    keep = [c for c in a.columns if c not in ("snapshot_id", "artifact_id")]
    return latest(a, ["snapshot_id", "artifact_id"], ["received_at"], keep)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct node rows; (snapshot_id, id) is the key."""
    return table(spark, folder, "nodes").withColumnRenamed("node_id", "id").distinct()


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "diagnostics").distinct()


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, name): regions, nations, customers, suppliers, parts and orders as vertices."""
    one = lambda t, p, key, kind, name: table(spark, folder, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    out = one("region", "r:", "r_regionkey", "namespace", "r_name")
    for args in (("nation", "n:", "n_nationkey", "module", "n_name"), ("customer", "c:", "c_custkey", "class", "c_name"), ("supplier", "s:", "s_suppkey", "class", "s_name"), ("part", "p:", "p_partkey", "type", "p_name"), ("orders", "o:", "o_orderkey", "function", "o_orderkey")):
        out = out.unionByName(one(*args))
    return out


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, from, to, resolution, confidence) over ``graph_nodes``."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def one(df: DataFrame, kind: str, a, b, n: str) -> DataFrame:
        how = F.when(F.col(n) % 7 == 0, "unresolved").when(F.col(n) % 5 == 0, "Resolved").when(F.col(n) % 3 == 0, "syntax-inferred").otherwise("declared")
        return df.select(F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"), how.alias("resolution"), ((F.col(n) % 10) / 10.0).alias("confidence"))

    t = lambda name: table(spark, folder, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    out = one(t("nation"), "contains", key("r:", "n_regionkey"), key("n:", "n_nationkey"), "n_nationkey")
    for more in (
        one(t("customer"), "references", key("c:", "c_custkey"), key("n:", "c_nationkey"), "c_custkey"),
        one(t("supplier"), "references", key("s:", "s_suppkey"), key("n:", "s_nationkey"), "s_suppkey"),
        one(t("orders"), "calls", key("c:", "o_custkey"), key("o:", "o_orderkey"), "o_orderkey"),
        one(lines.select("l_orderkey", "l_partkey").distinct(), "depends_on", key("o:", "l_orderkey"), key("p:", "l_partkey"), "l_partkey"),
        one(lines.select("l_orderkey", "l_suppkey").distinct(), "consumes", key("o:", "l_orderkey"), key("s:", "l_suppkey"), "l_suppkey"),
    ):
        out = out.unionByName(more)
    return out.withColumn("id", F.concat_ws("|", "from", "kind", "to"))


_BUILT: set[str] = set()


def _stored(spark: SparkSession, folder: str, name: str, build: Callable[[str], object]) -> str:
    """The folder of an index over a data folder, built once in an application, beside its checkpoints."""
    at = f"{ensure_checkpoint_dir(spark)}/strataloom-{spark.sparkContext.applicationId}/{name}-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    if at not in _BUILT:
        build(at)
        _BUILT.add(at)
    return at


def edge_index(spark: SparkSession, folder: str) -> EdgeIndex:
    """The stored index of ``graph_edges``."""
    return EdgeIndex.load(spark, _stored(spark, folder, "edges", lambda at: EdgeIndex.build(graph_edges(spark, folder), at)))


def lexical_index(spark: SparkSession, folder: str) -> LexicalIndex:
    """The stored index of ``search_docs`` over all fields."""
    return LexicalIndex.load(spark, _stored(spark, folder, "lexical", lambda at: LexicalIndex.build(search_docs(spark, folder), at)))


def fulltext_index(spark: SparkSession, folder: str) -> LexicalIndex:
    """The stored index of ``search_docs`` over titles, names, signatures and bodies."""
    return LexicalIndex.load(spark, _stored(spark, folder, "fulltext", lambda at: LexicalIndex.build(search_docs(spark, folder), at, FULLTEXT_BOOSTS, bonuses=False)))


def vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    """The stored index of the embeddings, which belong to the documents of the same ids."""
    return VectorIndex.load(spark, _stored(spark, folder, "vectors", lambda at: VectorIndex.build(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), at)))


def search_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, object_type, kind, language, title, qualified_name, signature, path, body) of the documents."""
    d = table(spark, folder, "documents")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("object_type"), F.coalesce(bare("source"), F.lit("")).alias("kind"), F.coalesce("lang", F.lit("")).alias("language"), name.alias("title"), F.col("path").alias("qualified_name"), F.lit("").alias("signature"), "path", F.coalesce("text", F.lit("")).alias("body"))


VIEWS_SQL = """
v_artifacts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(snapshot_id)), artifact_id ORDER BY received_at DESC) AS rn FROM artifacts) WHERE rn = 1),
v_nodes AS (SELECT DISTINCT * FROM nodes),
v_diagnostics AS (SELECT DISTINCT * FROM diagnostics)"""

_HOW = "CASE WHEN {n} % 7 = 0 THEN 'unresolved' WHEN {n} % 5 = 0 THEN 'Resolved' WHEN {n} % 3 = 0 THEN 'syntax-inferred' ELSE 'declared' END AS resolution, ({n} % 10) / 10.0::DOUBLE AS confidence"
GRAPH_SQL = f"""
g_nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'namespace' AS kind, r_name AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, 'module', n_name FROM nation UNION ALL SELECT 'c:' || c_custkey, 'class', c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'class', s_name FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'type', p_name FROM part UNION ALL SELECT 'o:' || o_orderkey, 'function', CAST(o_orderkey AS VARCHAR) FROM orders),
g_edges AS (SELECT "from" || '|' || kind || '|' || "to" AS id, * FROM (
  SELECT 'contains' AS kind, 'r:' || n_regionkey AS "from", 'n:' || n_nationkey AS "to", {_HOW.format(n="n_nationkey")} FROM nation
  UNION ALL SELECT 'references', 'c:' || c_custkey, 'n:' || c_nationkey, {_HOW.format(n="c_custkey")} FROM customer
  UNION ALL SELECT 'references', 's:' || s_suppkey, 'n:' || s_nationkey, {_HOW.format(n="s_suppkey")} FROM supplier
  UNION ALL SELECT 'calls', 'c:' || o_custkey, 'o:' || o_orderkey, {_HOW.format(n="o_orderkey")} FROM orders
  UNION ALL SELECT 'depends_on', 'o:' || l_orderkey, 'p:' || l_partkey, {_HOW.format(n="l_partkey")} FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'consumes', 'o:' || l_orderkey, 's:' || l_suppkey, {_HOW.format(n="l_suppkey")} FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)))"""

"""Queries on snapshot histories: the hierarchy and the changes along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import INTO_CYCLE, ON_CYCLE, descendants, hierarchy, intervals
from ..operators.snapshot_changes import bare_digest, compare_lineage, fetch_values, index_rows
from ..sources.tables import bare, latest, table

_ARTIFACT_FIELDS = ["content_sha256", "status", "language", "media_type", "generated_classification", "vendor_classification"]
_NODE_FIELDS = ["name", "qualified_name", "signature", "visibility", "artifact_id", "semantic_hash", "public_surface"]


def snapshot_links(spark: SparkSession, folder: str) -> DataFrame:
    """(id, parent, locality) of the valid row of each snapshot."""
    rows = table(spark, folder, "snapshots").select(bare("snapshot_id").alias("id"), bare("parent_snapshot_id").alias("parent"), "repository_id", "created_at", "received_at")
    valid = latest(rows.where(F.col("id").isNotNull()), ["id"], ["received_at"], ["parent", "repository_id", "created_at"])
    near = F.concat_ws("/", F.coalesce("repository_id", F.lit("")), F.coalesce(F.col("created_at").cast("string"), F.lit("")))
    return valid.select("id", "parent", near.alias("locality"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(snapshot_links(spark, folder), locality="locality", unique=True)
    return tree.select(
        F.col("id").alias("snapshot_id"),
        F.coalesce("root", F.lit("")).alias("root_snapshot_id"),
        F.when(F.col("status") == ON_CYCLE, -1).when(F.col("status") == INTO_CYCLE, -2).otherwise(F.col("depth")).cast("bigint").alias("tree_depth"),
        F.col("n_descendants").cast("bigint").alias("n_descendants"),
    )


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path from the root of every snapshot, as one string."""
    tree = hierarchy(snapshot_links(spark, folder), locality="locality", unique=True, with_paths=True)
    return tree.select(F.col("id").alias("snapshot_id"), F.concat_ws(">", "path").alias("path"), F.greatest(F.size("path"), F.lit(0)).cast("bigint").alias("path_length"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a snapshot and one below it."""
    pairs = descendants(hierarchy(snapshot_links(spark, folder), locality="locality", unique=True, with_paths=True))
    return pairs.select(F.col("id").alias("snapshot_id"), F.col("descendant").alias("descendant_id"), "distance")


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The descendants of every snapshot as an interval of places among the snapshots of its root."""
    spans = intervals(hierarchy(snapshot_links(spark, folder), locality="locality", unique=True, with_paths=True))
    return spans.select(F.col("id").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "first", "last")


def _artifact_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "artifacts").withColumn("version", bare("snapshot_id")).withColumn("content_sha256", bare_digest(F.col("content_sha256")))


def _node_rows(spark: SparkSession, folder: str) -> DataFrame:
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    by_name = F.when(filled("qualified_name").isNotNull(), F.concat_ws("|", F.coalesce("language", F.lit("")), F.coalesce("kind", F.lit("")), "qualified_name"))
    return table(spark, folder, "nodes").withColumn("version", bare("snapshot_id")).withColumn("logical_key", F.coalesce(filled("logical_id"), by_name, filled("node_id")))


def compared_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(version, parent) of snapshots that, like their parent, list artifacts."""
    links = snapshot_links(spark, folder)
    listed = table(spark, folder, "artifacts").select(bare("snapshot_id").alias("version")).where(F.col("version").isNotNull()).distinct()
    pairs = links.select(F.col("id").alias("version"), "parent", F.col("locality").alias("place")).where(F.col("parent").isNotNull())
    known = links.select(F.col("id").alias("parent"))
    return pairs.join(known, "parent", "left_semi").join(listed, "version", "left_semi").join(listed.withColumnRenamed("version", "parent"), "parent", "left_semi").select("version", "parent", "place")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    artifacts = index_rows(_artifact_rows(spark, folder), F.col("version"), F.col("path"), [F.col(c) for c in _ARTIFACT_FIELDS], F.col("received_at"))
    nodes = index_rows(_node_rows(spark, folder), F.col("version"), F.col("logical_key"), [F.col(c) for c in _NODE_FIELDS])
    index = artifacts.withColumn("family", F.lit("artifact")).unionByName(nodes.withColumn("family", F.lit("node")))
    return compare_lineage(index, compared_pairs(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select(F.col("version").alias("snapshot_id"), F.col("family").alias("record_family"), F.col("key").alias("logical_key"), "change_kind")


def p5_artifact_values(spark: SparkSession, folder: str) -> DataFrame:
    """Changed artifacts with the names of the changed fields and both digests."""
    rows = latest(_artifact_rows(spark, folder).where(F.col("version").isNotNull() & F.col("path").isNotNull()), ["version", "path"], ["received_at"], _ARTIFACT_FIELDS)
    changes = _changes(spark, folder).where(F.col("family") == "artifact")
    full = fetch_values(changes, rows.withColumnRenamed("path", "key"), compared_pairs(spark, folder).drop("place"), _ARTIFACT_FIELDS)
    return full.select(F.col("version").alias("snapshot_id"), F.col("key").alias("path"), "change_kind", F.concat_ws(",", "changed").alias("changed"), F.coalesce("old.content_sha256", F.lit("")).alias("old_sha256"), F.coalesce("new.content_sha256", F.lit("")).alias("new_sha256"))


_LINKS_SQL = """
valid AS (
  SELECT id, parent FROM (
    SELECT lower(trim(snapshot_id, E' \\t\\r\\n')) AS id, nullif(lower(trim(parent_snapshot_id, E' \\t\\r\\n')), '') AS parent,
           row_number() OVER (PARTITION BY lower(trim(snapshot_id, E' \\t\\r\\n')) ORDER BY received_at DESC) AS rn
    FROM snapshots) WHERE rn = 1),
links AS (SELECT v.id, p.id AS parent FROM valid v LEFT JOIN valid p ON v.parent = p.id)"""

_WALK_SQL = f"""
WITH RECURSIVE {_LINKS_SQL},
down AS (
  SELECT id, id AS root, 0 AS depth, [id] AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.id, d.root, d.depth + 1, list_append(d.path, l.id) FROM links l JOIN down d ON l.parent = d.id),
lost AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM down)),
walk AS (
  SELECT id AS start, parent AS spot FROM lost
  UNION
  SELECT w.start, l.parent FROM walk w JOIN lost l ON w.spot = l.id),
ring AS (SELECT DISTINCT start AS id FROM walk WHERE start = spot),
below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(path[:-2]) AS a FROM down) GROUP BY a)"""

ORACLE = {
    "p4_found": f"""{_WALK_SQL}
SELECT id AS snapshot_id, root AS root_snapshot_id, CAST(depth AS BIGINT) AS tree_depth, CAST(coalesce(n, 0) AS BIGINT) AS n_descendants
FROM down LEFT JOIN below USING (id)
UNION ALL
SELECT id, '', CASE WHEN id IN (SELECT id FROM ring) THEN -1 ELSE -2 END, -1 FROM lost""",
    "p4_paths": f"""{_WALK_SQL}
SELECT id AS snapshot_id, array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS path_length FROM down
UNION ALL SELECT id, '', 0 FROM lost""",
    "p4_intervals": f"""{_WALK_SQL},
placed AS (SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY array_to_string(path, chr(0))) - 1 AS first FROM down)
SELECT id AS snapshot_id, root AS root_snapshot_id, first, CAST(first + coalesce(n, 0) AS BIGINT) AS last FROM placed LEFT JOIN below USING (id)""",
    "p4_descendants": f"""{_WALK_SQL}
SELECT a AS snapshot_id, id AS descendant_id, CAST(len(path) - spot AS BIGINT) AS distance
FROM (SELECT id, path, unnest(path[:-2]) AS a, unnest(range(1, len(path))) AS spot FROM down)""",
}

_INDEX_SQL = """
art AS (
  SELECT * FROM (
    SELECT lower(trim(snapshot_id)) AS version, 'artifact' AS family, path AS key,
      concat_ws(chr(1), regexp_replace(lower(trim(coalesce(content_sha256, ''))), '^sha256:', ''), coalesce(status, ''), coalesce(language, ''), coalesce(media_type, ''), coalesce(generated_classification, ''), coalesce(vendor_classification, '')) AS val,
      row_number() OVER (PARTITION BY lower(trim(snapshot_id)), path ORDER BY received_at DESC) AS rn
    FROM artifacts) WHERE rn = 1),
nod AS (
  SELECT DISTINCT lower(trim(snapshot_id)) AS version, 'node' AS family,
    coalesce(nullif(logical_id, ''), CASE WHEN coalesce(qualified_name, '') <> '' THEN coalesce(language, '') || '|' || coalesce(kind, '') || '|' || qualified_name END, node_id) AS key,
    concat_ws(chr(1), coalesce(name, ''), coalesce(qualified_name, ''), coalesce(signature, ''), coalesce(visibility, ''), coalesce(artifact_id, ''), coalesce(semantic_hash, ''), coalesce(CAST(public_surface AS VARCHAR), '')) AS val
  FROM nodes),
idx AS (SELECT version, family, key, val FROM art UNION ALL SELECT version, family, key, val FROM nod),
pairs AS (SELECT id AS version, parent FROM links WHERE parent IS NOT NULL AND id IN (SELECT version FROM art) AND parent IN (SELECT version FROM art)),
newer AS (SELECT p.version, i.family, i.key, i.val FROM pairs p JOIN idx i ON i.version = p.version),
older AS (SELECT p.version, i.family, i.key, i.val FROM pairs p JOIN idx i ON i.version = p.parent)"""

ORACLE["p5_found"] = f"""WITH {_LINKS_SQL},{_INDEX_SQL}
SELECT coalesce(n.version, o.version) AS snapshot_id, coalesce(n.family, o.family) AS record_family, coalesce(n.key, o.key) AS logical_key,
  CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END AS change_kind
FROM newer n FULL OUTER JOIN older o ON n.version = o.version AND n.family = o.family AND n.key = o.key
WHERE o.key IS NULL OR n.key IS NULL OR n.val <> o.val"""

_VALUES = {"content_sha256": "regexp_replace(lower(trim(coalesce(content_sha256, ''))), '^sha256:', '')", **{c: f"coalesce({c}, '')" for c in _ARTIFACT_FIELDS[1:]}}
ORACLE["p5_artifact_values"] = f"""WITH {_LINKS_SQL},
art AS (SELECT * FROM (SELECT lower(trim(snapshot_id)) AS version, path AS key, {", ".join(f"{v} AS {c}" for c, v in _VALUES.items())}, row_number() OVER (PARTITION BY lower(trim(snapshot_id)), path ORDER BY received_at DESC) AS rn FROM artifacts) WHERE rn = 1),
pairs AS (SELECT id AS version, parent FROM links WHERE parent IS NOT NULL AND id IN (SELECT version FROM art) AND parent IN (SELECT version FROM art)),
n AS (SELECT p.version AS v, a.* FROM pairs p JOIN art a ON a.version = p.version), o AS (SELECT p.version AS v, a.* FROM pairs p JOIN art a ON a.version = p.parent)
SELECT coalesce(n.v, o.v) AS snapshot_id, coalesce(n.key, o.key) AS path, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END AS change_kind,
  CASE WHEN o.key IS NULL OR n.key IS NULL THEN '' ELSE concat_ws(',', {", ".join(f"CASE WHEN n.{c} <> o.{c} THEN '{c}' END" for c in _VALUES)}) END AS changed,
  coalesce(o.content_sha256, '') AS old_sha256, coalesce(n.content_sha256, '') AS new_sha256
FROM n FULL OUTER JOIN o ON n.v = o.v AND n.key = o.key WHERE o.key IS NULL OR n.key IS NULL OR {" OR ".join(f"n.{c} <> o.{c}" for c in _VALUES)}"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_intervals": p4_intervals, "p5_found": p5_found, "p5_artifact_values": p5_artifact_values}

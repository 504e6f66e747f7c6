"""Inventory, extraction, windows, exports and incremental work over the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify, strip_markdown
from ..operators import incremental as I
from ..operators import packets as P
from ..operators import redaction, windows
from ..operators.extract import code, manifests, markdown
from ..sinks import exports
from ..sources import tree
from ..sources.tables import bare, table
from ..streaming import pipelines
from . import views
from .views import GRAPH_SQL, VIEWS_SQL


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts as files: digest, status, lines, language."""
    files = _docs(spark, folder).select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return tree.inspect(files).select("path", "size_bytes", "sha256", "status", F.coalesce("line_count", F.lit(-1)).cast("bigint").alias("line_count"), "language")


def excluded_paths(spark: SparkSession, folder: str) -> DataFrame:
    why = tree.excluded_by(F.col("path"), ["vendor", "node_modules", "build/stubs", "docs"])
    return views.artifacts(spark, folder).groupBy(why.alias("reason")).agg(F.count("*").alias("n")).where(F.col("reason").isNotNull())


def doc_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Hash headings of all texts, by line."""
    d = _docs(spark, folder).select("doc_id", F.split("text", "\n").alias("x"))
    lines = d.select("doc_id", F.size("x").alias("lines"), F.posexplode("x").alias("i", "line")).where(F.rlike("line", F.lit("^#{1,6} ")))
    marks = F.length(F.regexp_extract("line", "^#+", 0))
    return lines.select("doc_id", "lines", (F.col("i") + 1).alias("start_line"), F.col("i").alias("ordinal"), marks.alias("level"), slugify(strip_markdown(F.col("line"))).alias("slug"))


def parent_heading(spark: SparkSession, folder: str) -> DataFrame:
    return windows.parent_headings(doc_headings(spark, folder)).select("doc_id", "ordinal", F.coalesce("parent", F.lit(-1)).alias("parent"))


def anchor_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return windows.unique_anchors(doc_headings(spark, folder)).select("doc_id", "ordinal", "anchor")


def section_ends(spark: SparkSession, folder: str) -> DataFrame:
    return windows.section_ends(doc_headings(spark, folder)).select("doc_id", "start_line", "end_line")


def byte_budget_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each source, shortest first, that fit into 50 000 characters."""
    d = _docs(spark, folder).select("doc_id", F.coalesce(bare("source"), F.lit("")).alias("source"), "n_chars")
    return windows.byte_budget(d, ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 50_000).select("doc_id", "source", "running")


def canonical_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    n = views.nodes(spark, folder).select("snapshot_id", "id")
    return windows.ordinals(n, "snapshot_id", "id").select("snapshot_id", "id", F.col("ordinal").cast("bigint").alias("ordinal"))


def hash_chain_check(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a journal for each user; every 97th record is altered, every 101st missing."""
    e = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.row_number().over(w).cast("bigint").alias("sequence"), F.sha2(F.col("event_id").cast("string"), 256).alias("record_digest"), F.coalesce(F.sha2(F.lag("event_id").over(w).cast("string"), 256), F.lit("")).alias("previous_digest"), "event_id")
    spoilt = rows.withColumn("previous_digest", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.col("previous_digest"))).where(F.col("event_id") % 101 != 0)
    return windows.chain_breaks(spoilt)


def text_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each snapshot packed into parts of 20 000 characters."""
    d = _docs(spark, folder).select("snapshot_id", "doc_id", F.col("n_chars").alias("size"))
    return windows.packs(d, "snapshot_id", "doc_id", 20_000, header=60).groupBy("snapshot_id", "part").agg(F.count("*").alias("n"))


def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.section_table(_docs(spark, folder).where(F.col("path").endswith(".md")))


def doc_links(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.link_table(_docs(spark, folder), views.artifacts(spark, folder))


def python_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return code.python_table(_docs(spark, folder).where(F.col("path").endswith(".py")))


def go_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return code.go_table(_docs(spark, folder).where(F.col("path").endswith(".go")))


def ecma_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return code.ecma_table(_docs(spark, folder).where(F.col("path").rlike(r"\.[jt]s$")))


def enclosing_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The innermost node around the middle line of every node of its file."""
    n = views.nodes(spark, folder).where(F.col("artifact_id").isNotNull() & F.col("start_line").isNotNull())
    key = F.concat_ws("/", "snapshot_id", "artifact_id")
    occ = n.select(key.alias("doc_id"), F.col("id").alias("occurrence"), F.floor((F.col("start_line") + F.col("end_line")) / 2).cast("bigint").alias("line"))
    defs = n.select(key.alias("doc_id"), F.col("id").alias("symbol"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))
    return code.enclosing(occ, defs)


def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.manifest_table(_docs(spark, folder))


def dotenv_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Variables of the dotenv files of each snapshot: the first of each name, by path and line."""
    files = _docs(spark, folder).where(F.col("path").endswith(".env"))
    rows = manifests.manifest_table(files).where(F.col("kind") == "environment_variable").select("doc_id", "name", "line")
    placed = rows.join(files.select("doc_id", bare("snapshot_id").alias("snapshot_id"), "path"), "doc_id")
    return placed.groupBy("snapshot_id", "name").agg(F.min(F.struct("path", "line", "doc_id")).alias("f")).select("snapshot_id", "name", "f.path", "f.line", "f.doc_id")


def pattern_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the small pattern table, by kind."""
    return redaction.findings(_docs(spark, folder)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= redaction.HIGH).alias("high"))


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("total"), F.max(k).alias("most"))


def sarif_results(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics by rule and level, as the report has them."""
    d = views.diagnostics(spark, folder).withColumnRenamed("diagnostic_id", "id")
    rules = exports.sarif_rules(d).withColumnRenamed("message", "rule")
    return d.groupBy("code", exports.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n")).join(rules, "code")


def symbol_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = views.nodes(spark, folder).withColumn("source", F.struct(F.lit("").alias("path"), "start_line", "end_line")).withColumn("evidence_ids", F.array("semantic_hash"))
    return exports.symbol_rows(n).groupBy("kind", "language").agg(F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"))


def graphml_lines(spark: SparkSession, folder: str) -> DataFrame:
    return exports.graphml_lines(views.graph_nodes(spark, folder), views.graph_edges(spark, folder)).select("line")


def incremental_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a run over the documents would restore, when those of every third id have been done."""
    d = _docs(spark, folder)
    files = I.file_keys(d.select("doc_id", F.concat_ws("/", "snapshot_id", "path").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes")), "markdown", "1")
    return I.plan(files.drop("doc_id"), files.where(F.col("doc_id") % 3 == 0).select("key"))


def cache_prune(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact deliveries as cache entries: content that only old entries need."""
    a = table(spark, folder, "artifacts").where(F.col("content_sha256").isNotNull())
    entries = a.select(F.concat_ws("/", "snapshot_id", "artifact_id").alias("key"), F.col("content_sha256").alias("object_digest"), F.col("received_at").alias("last_access"), F.lit(1).alias("size_bytes"))
    return I.prune(entries, "2025-08-05 00:00:00")[1].select("object_digest")


def packet_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The one-hop packet of an order: its nodes and edges."""
    n = views.graph_nodes(spark, folder).withColumn("evidence_ids", F.array(F.concat(F.lit("e:"), "id")))
    e = views.graph_edges(spark, folder).withColumn("evidence_ids", F.array(F.concat(F.lit("e:"), "id")))
    p = P.one_hop("o:7", n, e, n.select(F.concat(F.lit("e:"), "id").alias("id")))
    return p.nodes.select(F.lit("node").alias("part"), "id").unionByName(p.edges.select(F.lit("edge").alias("part"), "id")).unionByName(p.evidence.select(F.lit("evidence").alias("part"), "id"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.tumbling(table(spark, folder, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users with a gap of six hours, by length."""
    s = pipelines.sessions(table(spark, folder, "events"), "6 hours")
    return s.groupBy("n").agg(F.count("*").alias("sessions"))


QUERIES = {
    f.__name__: f
    for f in (
        artifact_inventory, excluded_paths, parent_heading, anchor_suffix, section_ends, byte_budget_cutoff, canonical_ordinals, hash_chain_check, text_packs, doc_sections, doc_links, python_symbols, go_symbols, ecma_symbols, enclosing_symbols, manifest_rows,
        dotenv_keys, pattern_findings, json_props, sarif_results, symbol_csv_rows, graphml_lines, incremental_plan, cache_prune, packet_evidence, event_windows, event_sessions,
    )
}

_HEADS = r"""
ln AS (SELECT doc_id, len(x) AS lines, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
hd AS (SELECT doc_id, lines, i + 1 AS start_line, i AS ordinal, len(regexp_extract(line, '^#+')) AS level, regexp_replace(regexp_replace(lower(trim(translate(line, '`*_#', ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ln WHERE regexp_matches(line, '^#{1,6} '))"""
_LANG = " ".join(f"WHEN '.{e}' THEN '{lang}'" for lang, ends in tree.ENDINGS.items() for e in ends.split())
_SYMBOLS = "('module','namespace','package','class','interface','trait','type','enum','enum_member','function','method','constructor','field','property','variable','constant','parameter','test')"
_XML = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"

ORACLE = {
    "artifact_inventory": rf"""SELECT doc_id || '/' || path AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN octet_length(encode(text)) > 2097152 THEN 'oversized' ELSE 'text' END AS status,
CAST(CASE WHEN octet_length(encode(text)) > 2097152 THEN -1 WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS line_count,
coalesce(CASE lower(regexp_extract(path, '[^/]*$')) WHEN 'dockerfile' THEN 'dockerfile' WHEN 'makefile' THEN 'make' WHEN 'requirements.txt' THEN 'requirements' END, CASE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]*$')) {_LANG} END, '') AS language FROM documents""",
    "excluded_paths": f"""WITH {VIEWS_SQL}, x AS (SELECT CASE WHEN starts_with(path, 'vendor/') THEN 'vendor' WHEN starts_with(path, 'node_modules/') THEN 'node_modules' WHEN starts_with(path, 'build/stubs/') THEN 'build/stubs' WHEN starts_with(path, 'docs/') THEN 'docs' END AS reason FROM v_artifacts) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason""",
    "parent_heading": f"WITH {_HEADS} SELECT h.doc_id, h.ordinal, coalesce(max(p.ordinal), -1) AS parent FROM hd h LEFT JOIN hd p ON p.doc_id = h.doc_id AND p.ordinal < h.ordinal AND p.level < h.level GROUP BY h.doc_id, h.ordinal",
    "anchor_suffix": f"WITH {_HEADS}, b AS (SELECT doc_id, ordinal, CASE WHEN slug = '' THEN 'section' ELSE slug END AS s FROM hd), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY ordinal) AS n FROM b) SELECT doc_id, ordinal, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS anchor FROM n",
    "section_ends": f"WITH {_HEADS} SELECT doc_id, start_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY ordinal) - 1, lines) AS end_line FROM hd",
    "byte_budget_cutoff": "SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, lower(trim(coalesce(source, ''))) AS source, sum(n_chars) OVER (PARTITION BY lower(trim(coalesce(source, ''))) ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000",
    "canonical_ordinals": f"WITH {VIEWS_SQL} SELECT snapshot_id, node_id AS id, row_number() OVER (PARTITION BY snapshot_id ORDER BY node_id) - 1 AS ordinal FROM v_nodes",
    "hash_chain_check": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER w AS sequence, sha256(CAST(event_id AS VARCHAR)) AS d, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE coalesce(sha256(CAST(lag(event_id) OVER w AS VARCHAR)), '') END AS p, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, lag(sequence) OVER v AS ps, lag(d) OVER v AS pd FROM (SELECT * FROM r WHERE event_id % 101 <> 0) WINDOW v AS (PARTITION BY run_id ORDER BY sequence))
SELECT run_id, sequence, CASE WHEN sequence <> coalesce(ps + 1, 1) THEN 'gap' ELSE 'broken' END AS problem FROM k WHERE sequence <> coalesce(ps + 1, 1) OR p <> coalesce(pd, '')""",
    "enclosing_symbols": f"""WITH {VIEWS_SQL}, n AS (SELECT snapshot_id || '/' || artifact_id AS doc_id, node_id AS id, start_line AS s, end_line AS e, CAST(floor((start_line + end_line) / 2) AS BIGINT) AS line FROM v_nodes WHERE artifact_id IS NOT NULL AND start_line IS NOT NULL)
SELECT o.doc_id, o.id AS occurrence, coalesce(arg_min(d.id, (d.e - d.s, d.s, d.id)), '') AS symbol FROM n o LEFT JOIN n d ON d.doc_id = o.doc_id AND d.s <= o.line AND o.line <= d.e GROUP BY o.doc_id, o.id""",
    "dotenv_keys": r"""WITH l AS (SELECT doc_id, lower(trim(snapshot_id)) AS snapshot_id, path, trim(unnest(x), E' \t\r') AS line, unnest(range(1, len(x) + 1)) AS n FROM (SELECT doc_id, snapshot_id, path, string_split(text, chr(10)) AS x FROM documents WHERE ends_with(path, '.env'))),
k AS (SELECT doc_id, snapshot_id, path, n, trim(split_part(CASE WHEN starts_with(line, 'export ') THEN line[8:] ELSE line END, '=', 1), E' \t\r') AS name FROM l WHERE line <> '' AND left(line, 1) NOT IN ('#', ';'))
SELECT snapshot_id, name, path, n AS line, doc_id FROM k WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') QUALIFY row_number() OVER (PARTITION BY snapshot_id, name ORDER BY path, n, doc_id) = 1""",
    "json_props": "SELECT event_type, count(*) AS n, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
    "sarif_results": f"""WITH {VIEWS_SQL}, r AS (SELECT code, arg_min(message, (diagnostic_id, message)) AS rule FROM v_diagnostics GROUP BY code)
SELECT code, CASE WHEN severity IN ('fatal', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END AS level, count(*) AS n, any_value(rule) AS rule FROM v_diagnostics JOIN r USING (code) GROUP BY 1, 2""",
    "symbol_csv_rows": f"WITH {VIEWS_SQL} SELECT kind, language, count(*) AS n, count(*) AS evidence FROM v_nodes WHERE kind IN {_SYMBOLS} GROUP BY kind, language",
    "graphml_lines": f"""WITH {GRAPH_SQL} SELECT '<node id="' || {_XML.format('id')} || '"><data key="kind">' || {_XML.format('kind')} || '</data><data key="name">' || {_XML.format('name')} || '</data></node>' AS line FROM g_nodes
UNION ALL SELECT '<edge id="' || {_XML.format('id')} || '" source="' || {_XML.format('"from"')} || '" target="' || {_XML.format('"to"')} || '"><data key="kind">' || {_XML.format('kind')} || '</data></edge>' FROM g_edges""",
    "incremental_plan": "WITH f AS (SELECT doc_id, n_chars, snapshot_id || '/' || path AS p, sha256(text) AS s FROM documents) SELECT CASE WHEN (p, s) IN (SELECT (p, s) FROM f WHERE doc_id % 3 = 0) THEN 'restore' ELSE 'run' END AS disposition, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM f GROUP BY 1",
    "cache_prune": "SELECT DISTINCT content_sha256 AS object_digest FROM artifacts WHERE content_sha256 IS NOT NULL AND received_at < TIMESTAMP '2025-08-05' AND content_sha256 NOT IN (SELECT content_sha256 FROM artifacts WHERE content_sha256 IS NOT NULL AND received_at >= TIMESTAMP '2025-08-05')",
    "packet_evidence": f"""WITH {GRAPH_SQL}, ed AS (SELECT * FROM g_edges WHERE "from" = 'o:7' OR "to" = 'o:7' ORDER BY kind, "from", "to", id LIMIT 64), nd AS (SELECT id FROM g_nodes WHERE id = 'o:7' UNION ALL (SELECT id FROM g_nodes WHERE id <> 'o:7' AND id IN (SELECT "from" FROM ed UNION SELECT "to" FROM ed) ORDER BY id LIMIT 24)),
ek AS (SELECT id FROM ed WHERE "from" IN (SELECT id FROM nd) AND "to" IN (SELECT id FROM nd))
SELECT 'node' AS part, id FROM nd UNION ALL SELECT 'edge', id FROM ek UNION ALL SELECT * FROM (SELECT 'evidence', 'e:' || id FROM nd ORDER BY 2 LIMIT 64)""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) GROUP BY n""",
}

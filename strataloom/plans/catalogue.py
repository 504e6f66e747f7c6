"""Record queries, coverage, validation, merging and diffs over the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_id, row_digest, stable_id
from ..functions.text import basename, extension, first_filled, line_count, slugify
from ..operators import coverage as C
from ..operators import merge as M
from ..operators import records as R
from ..operators import semantic_diff as D
from ..operators import validate as V
from ..sources.tables import bare, table
from ..vocabulary import is_public, is_symbol, normal_resolution, resolution_rank, status_rank
from . import views
from .views import GRAPH_SQL, VIEWS_SQL

_FILLED = "coalesce({0}, '')"


def node_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of public Python functions, by snapshot and id."""
    some = R.filter_nodes(views.nodes(spark, folder), kind="function", language="python", visibility="public")
    page, _ = R.keyset_page(some.withColumn("key", F.concat_ws("/", "snapshot_id", "id")), "key")
    return page.select("snapshot_id", "id", "name")


def keyset_page_2(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind a cursor in the middle of the edge ids."""
    page, _ = R.keyset_page(R.filter_edges(views.graph_edges(spark, folder), kind="calls", resolution="resolved"), "id", after="c:5", size=100)
    return page.select("id", "from", "to")


def diagnostic_filter(spark: SparkSession, folder: str) -> DataFrame:
    return R.filter_diagnostics(views.diagnostics(spark, folder), severity="warning", stage="extract").select("diagnostic_id", "code")


def artifact_list(spark: SparkSession, folder: str) -> DataFrame:
    """Go artifacts below a directory, by status."""
    return R.filter_artifacts(views.artifacts(spark, folder), language="go", path_prefix="src/").groupBy("status").agg(F.count("*").alias("n"))


def snapshot_page(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshots before a point, newest first."""
    s = table(spark, folder, "snapshots").select("snapshot_id", "created_at").distinct()
    page, _ = R.time_page(s, "created_at", "snapshot_id", before=("2025-08-05 00:00:00", ""), size=40)
    return page


def facets(spark: SparkSession, folder: str) -> DataFrame:
    return R.facets(views.nodes(spark, folder), views.graph_edges(spark, folder), views.artifacts(spark, folder), views.diagnostics(spark, folder))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    a = views.artifacts(spark, folder)
    return a.select("snapshot_id", "path", stable_id("artifact", F.col("snapshot_id"), F.col("path")).alias("stable_id"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by content id: files, distinct names and lines."""
    d = table(spark, folder, "documents")
    return d.groupBy(content_id(F.col("text")).alias("content_id")).agg(F.count("*").alias("files"), F.max(line_count(F.col("text"))).cast("bigint").alias("lines"))


def row_digests(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder).select("snapshot_id", "id", row_digest(F.col("kind"), F.col("name"), F.col("qualified_name")).alias("digest"))


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "documents")
    return p.select("doc_id", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ending"), slugify(F.col("path")).alias("slug"), first_filled(F.col("lang"), F.lit("none")).alias("lang"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "redaction_records").distinct()
    return r.select(F.col("fingerprint").alias("id"), "artifact_id", F.when(F.col("confidence") >= 0.5, F.array("fingerprint")).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))


def _coverage_families(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    a = views.artifacts(spark, folder).select("status", (F.col("is_text") == 1).alias("text"), F.lit(False).alias("semantic"))
    n = views.nodes(spark, folder).select(
        "id", "kind", "visibility", F.col("public_surface").cast("boolean").alias("public_surface"), F.when(F.coalesce("semantic_hash", F.lit("")) != "", F.array("semantic_hash")).alias("evidence_ids"), F.lit(None).cast("string").alias("documentation"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("confidence_class"),
    )
    r = table(spark, folder, "redaction_records").distinct()
    secrets = r.select(
        F.col("fingerprint").alias("id"), F.lit("secret").alias("kind"), F.lit(None).cast("string").alias("visibility"), F.lit(False).alias("public_surface"), F.lit(None).cast("array<string>").alias("evidence_ids"), F.lit(None).cast("string").alias("documentation"), "confidence", F.lit(None).cast("string").alias("confidence_class")
    )
    docs = views.nodes(spark, folder).where(F.col("end_line") - F.col("start_line") >= 9).select(F.when(F.col("start_line") % 3 == 0, "stale").otherwise("validated").alias("status"), F.array("id").alias("subject_ids"))
    conflicts = table(spark, folder, "repositories").where(F.col("canonical_origin").isNull()).distinct()
    return {"artifacts": a, "nodes": n.unionByName(secrets), "edges": views.graph_edges(spark, folder), "claims": _claims(spark, folder), "documents": docs, "conflicts": conflicts}


def coverage_row(spark: SparkSession, folder: str) -> DataFrame:
    f = _coverage_families(spark, folder)
    return C.coverage(f["artifacts"], f["nodes"], f["edges"], f["claims"], f["documents"], f["conflicts"])


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.count_map(views.artifacts(spark, folder), "status", trim=True).select(F.explode("counts").alias("status", "n"))


def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    gates = C.quality_gates(coverage_row(spark, folder), views.diagnostics(spark, folder), edge_resolution=0.9, syntactic=0.2, public_documentation=0.5)
    return gates.select(F.concat_ws(",", "failures").alias("failures"))


def dangling_references(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and diagnostics whose artifact isn't listed in their snapshot, and other violations of the rules."""
    key = lambda c: F.concat_ws("/", bare("snapshot_id"), F.col(c))
    a = views.artifacts(spark, folder)
    families = {
        "artifacts": a.select(key("artifact_id").alias("id"), key("path").alias("path"), "kind", "status", "size_bytes", F.regexp_replace(F.lower("content_sha256"), "^sha256:", "").alias("sha256")),
        "nodes": views.nodes(spark, folder).select(key("id").alias("id"), "kind", "name", key("artifact_id").alias("artifact_id"), "start_line", "end_line"),
        "diagnostics": views.diagnostics(spark, folder).select(key("diagnostic_id").alias("id"), "severity", "code", F.when(F.col("artifact_id").isNotNull(), key("artifact_id")).alias("artifact_id")),
    }
    return V.violations(families)


def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that the delivered artifact rows hold more than once."""
    a = table(spark, folder, "artifacts").select(F.concat_ws("/", "snapshot_id", "artifact_id").alias("id"))
    return V._repeated(a, "DUPLICATE_ARTIFACT_ID")


def edge_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Edge rules on edges some of which lead nowhere."""
    e = views.graph_edges(spark, folder)
    lost = e.where(F.col("kind") == "contains").withColumns({"to": F.concat(F.lit("x:"), F.col("to")), "id": F.concat(F.col("id"), F.lit("|lost")), "confidence": F.lit(1.5), "resolution": F.lit("guessed")})
    families = {"nodes": views.graph_nodes(spark, folder).select("id", "kind", "name", F.lit(None).cast("string").alias("artifact_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")), "edges": e.unionByName(lost)}
    return V.violations(families)


def merge_artifact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered artifact rows merged by status rank, the first delivered among equals."""
    a = table(spark, folder, "artifacts")
    key = F.concat_ws("/", "snapshot_id", "artifact_id")
    rows = a.select(key.alias("id"), "status", "path", F.unix_micros(F.col("received_at").cast("timestamp")).alias("seq"))
    return M.merge_artifacts(rows)


def merge_edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as edges from parts to suppliers, merged by resolution rank."""
    line = table(spark, folder, "lineitem")
    how = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_linestatus") == "O", "declared").otherwise("observed")
    rows = line.select(
        stable_id("edge", F.lit("consumes"), F.col("l_partkey"), F.col("l_suppkey")).alias("id"), F.lit("consumes").alias("kind"), F.col("l_partkey").cast("string").alias("from"), F.col("l_suppkey").cast("string").alias("to"),
        how.alias("resolution"), F.round(F.col("l_discount"), 4).alias("confidence"), F.struct("l_orderkey", "l_linenumber", F.col("l_discount").alias("d"), "l_returnflag").alias("seq"),
    )
    return M.merge_edges(rows)


def logical_entities(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "snapshots").groupBy("snapshot_id").agg(F.max("created_at").alias("at"))
    return M.logical_entities(views.nodes(spark, folder), s)


def ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Derived predicates of nodes, artifacts and edges, counted."""
    n = views.nodes(spark, folder).groupBy(is_symbol("kind").alias("flag"), is_public(F.col("public_surface"), F.col("visibility")).alias("flag2")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.concat_ws("/", F.col("flag").cast("string"), F.col("flag2").cast("string")).alias("value"), "n")
    a = views.artifacts(spark, folder).groupBy(status_rank(F.col("status")).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("artifact").alias("what"), "value", "n")
    e = views.graph_edges(spark, folder).groupBy(F.concat_ws("/", normal_resolution("resolution"), resolution_rank(F.col("resolution")).cast("string")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "value", "n")
    return n.unionByName(a).unionByName(e)


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes of two snapshots: some gone, some changed, some new."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    row = lambda k, name, sig: (
        k.cast("string").alias("id"), F.concat(F.lit("l:"), k.cast("string")).alias("logical_id"), F.lit("function").alias("kind"), F.lit("go").alias("language"), F.col("o_orderpriority").alias("name"), name.alias("qualified_name"), sig.alias("signature"),
        F.when(key % 3 == 0, "public").otherwise("private").alias("visibility"), (key % 4 == 0).alias("public_surface"), F.col("o_custkey").cast("string").alias("artifact_id"), F.when(key % 41 == 0, "h").otherwise(F.col("o_orderstatus")).alias("semantic_hash"),
    )
    before = o.select(*row(key, F.col("o_orderpriority"), F.col("o_orderstatus"))).withColumn("semantic_hash", F.lit("h"))
    after = o.where(key % 50 != 0).select(*row(key, F.when(key % 43 == 0, "moved").otherwise(F.col("o_orderpriority")), F.when(key % 37 == 0, "X").otherwise(F.col("o_orderstatus")))).withColumn("semantic_hash", F.when(F.col("id").cast("bigint") % 41 == 0, "h2").otherwise("h"))
    fresh = o.where(key % 60 == 0).select(*row(key + 10_000_000, F.col("o_orderpriority"), F.col("o_orderstatus")))
    return before, after.unionByName(fresh)


def semantic_diff(spark: SparkSession, folder: str) -> DataFrame:
    d = D.diff_nodes(*_orders(spark, folder))
    return d.select("key", "change_kind", F.concat_ws(",", "changed").alias("changed"), "severity", F.concat_ws(";", "reasons").alias("reasons"))


def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = views.graph_edges(spark, folder).select("id", "kind", "from", "to", "resolution", "confidence", F.lit("p").alias("producer"))
    moved = e.where(F.col("confidence") != 0.3).withColumn("resolution", F.when(F.col("resolution") == "Resolved", "compiler_resolved").when(F.col("confidence") == 0.4, "unresolved").otherwise(F.col("resolution")))
    p = table(spark, folder, "part").select(F.col("p_name").alias("path"), F.col("p_brand").alias("sha256"), F.lit("text").alias("status"), F.col("p_type").alias("language"), F.lit("t").alias("media_type"), F.lit("").alias("generated"), F.lit(None).cast("string").alias("vendored"), F.col("p_partkey").alias("seq"))
    q = p.where(F.col("seq") % 11 != 0).withColumn("sha256", F.when(F.col("seq") % 13 == 0, "new").otherwise(F.col("sha256")))
    return D.summary(D.diff_artifacts(p, q), D.diff_nodes(*_orders(spark, folder)), D.diff_edges(e, moved))


QUERIES = {
    f.__name__: f
    for f in (
        node_filter_page, keyset_page_2, diagnostic_filter, artifact_list, snapshot_page, facets, stable_ids, content_ids, row_digests, path_parts, coverage_row, status_counts, quality_gates, dangling_references, duplicate_ids, edge_rules,
        merge_artifact_rows, merge_edge_rows, logical_entities, ranks, semantic_diff, diff_summary,
    )
}

_NORM = "CASE lower(trim(resolution)) WHEN 'resolved' THEN 'compiler_resolved' WHEN 'observed' THEN 'runtime_observed' WHEN 'syntax-inferred' THEN 'syntax_inferred' WHEN 'runtime-observed' THEN 'runtime_observed' ELSE lower(trim(resolution)) END"
_SYMBOLS = "('module','namespace','package','class','interface','trait','type','enum','enum_member','function','method','constructor','field','property','variable','constant','parameter','test','api_service','api_endpoint','api_operation','security_scheme','rpc_service','rpc_method','cli_command','cli_argument','cli_flag','config_key','environment_variable','database_table','database_column','database_view','schema','message','event','topic','queue','build_target','deployment')"
_PUBLIC = "(coalesce(public_surface, 0) <> 0 OR coalesce(visibility IN ('public', 'exported'), false))"
_STATUS_RANK = "CASE status WHEN 'semantic_parsed' THEN 5 WHEN 'syntax_parsed' THEN 4 WHEN 'parsed' THEN 4 WHEN 'text' THEN 3 WHEN 'recorded' THEN 2 WHEN 'included' THEN 2 ELSE 1 END"
_RES_RANK = f"CASE {_NORM} WHEN 'compiler_resolved' THEN 7 WHEN 'runtime_observed' THEN 6 WHEN 'declared' THEN 5 WHEN 'syntax_inferred' THEN 4 WHEN 'documentation_asserted' THEN 3 WHEN 'model_inferred' THEN 2 ELSE 1 END"
_FIELD = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"

_COVERAGE_SQL = f"""
secret AS (SELECT DISTINCT * FROM redaction_records),
told AS (SELECT DISTINCT node_id AS id FROM v_nodes WHERE end_line - start_line >= 9 AND start_line % 3 <> 0),
ca AS (SELECT count(*) AS artifacts_encountered, count(*) AS artifacts_inventoried, count(*) FILTER (is_text = 1) AS text_artifacts,
  count(*) FILTER (is_text = 1 AND trim(status) NOT IN ('excluded','inventory_only','oversized','unsupported','redacted','unreadable')) AS eligible, count(*) FILTER (trim(status) IN ('parsed','syntax_parsed','semantic_parsed')) AS syntactically_parsed,
  count(*) FILTER (trim(status) = 'semantic_parsed') AS semantically_parsed, count(*) FILTER (trim(status) IN ('excluded','inventory_only','oversized','unsupported','redacted')) AS excluded,
  count(*) FILTER (trim(status) = 'binary') AS "binary", count(*) FILTER (trim(status) = 'unreadable') AS unreadable FROM v_artifacts),
cn AS (SELECT count(*) + (SELECT count(*) FROM secret) AS nodes_total, count(*) FILTER (kind IN {_SYMBOLS}) AS symbols_total, count(*) FILTER (kind IN {_SYMBOLS} AND coalesce(semantic_hash, '') <> '') AS symbols_with_evidence,
  count(*) FILTER (kind IN {_SYMBOLS} AND {_PUBLIC}) AS public_symbols, count(*) FILTER (kind IN {_SYMBOLS} AND {_PUBLIC} AND node_id IN (SELECT id FROM told)) AS public_symbols_documented,
  (SELECT count(*) FROM secret) AS secret_findings, (SELECT count(*) FROM secret WHERE confidence >= 0.9) AS high_confidence_secrets FROM v_nodes),
ce AS (SELECT count(*) AS edges_total, count(*) FILTER ({_NORM} IN ('declared','compiler_resolved','runtime_observed')) AS resolved_edges, count(*) FILTER ({_NORM} NOT IN ('declared','compiler_resolved','runtime_observed')) AS unresolved_edges FROM g_edges),
cc AS (SELECT count(*) AS claims_total, count(*) FILTER (confidence >= 0.5) AS claims_with_evidence FROM secret),
cx AS (SELECT count(*) AS conflicts_total FROM (SELECT DISTINCT * FROM repositories WHERE canonical_origin IS NULL)),
cov AS (SELECT *, CASE WHEN artifacts_encountered = 0 THEN 1.0 ELSE artifacts_inventoried / artifacts_encountered END AS inventory_ratio, CASE WHEN eligible = 0 THEN 1.0 ELSE syntactically_parsed / eligible END AS syntactic_ratio,
  CASE WHEN eligible = 0 THEN 1.0 ELSE semantically_parsed / eligible END AS semantic_ratio, CASE WHEN symbols_total = 0 THEN 1.0 ELSE symbols_with_evidence / symbols_total END AS symbol_evidence_ratio,
  CASE WHEN public_symbols = 0 THEN 1.0 ELSE public_symbols_documented / public_symbols END AS public_documentation_ratio, CASE WHEN edges_total = 0 THEN 1.0 ELSE resolved_edges / edges_total END AS edge_resolution_ratio,
  CASE WHEN claims_total = 0 THEN 1.0 ELSE claims_with_evidence / claims_total END AS claim_citation_ratio FROM ca, cn, ce, cc, cx)"""

_ORDER_COLS = "{key} AS k, o_orderkey AS o, o_orderpriority AS name, {name} AS qn, {sig} AS sig, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AS pub, CASE WHEN o_orderkey % 3 = 0 THEN 'public' ELSE 'private' END AS vis"
_DIFF_SQL = """
b AS (SELECT o_orderkey AS k, o_orderpriority AS qn, o_orderstatus AS sig, 'h' AS h, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AS pub FROM orders),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 43 = 0 THEN 'moved' ELSE o_orderpriority END AS qn, CASE WHEN o_orderkey % 37 = 0 THEN 'X' ELSE o_orderstatus END AS sig, CASE WHEN o_orderkey % 41 = 0 THEN 'h2' ELSE 'h' END AS h FROM orders WHERE o_orderkey % 50 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_orderpriority, o_orderstatus, 'h' FROM orders WHERE o_orderkey % 60 = 0),
j AS (SELECT 'l:' || coalesce(a.k, b.k) AS key, b.k IS NULL AS isnew, a.k IS NULL AS isold, coalesce(b.qn <> a.qn, false) AS dq, coalesce(b.sig <> a.sig, false) AS ds, coalesce(b.h <> a.h, false) AS dh, coalesce(b.pub, false) AS pub FROM b FULL OUTER JOIN a ON a.k = b.k),
nd AS (SELECT key, CASE WHEN isnew THEN 'added' WHEN isold THEN 'removed' ELSE 'modified' END AS change_kind,
  CASE WHEN isnew OR isold THEN '' ELSE concat_ws(',', CASE WHEN dq THEN 'qualified_name' END, CASE WHEN ds THEN 'signature' END, CASE WHEN dh THEN 'semantic_hash' END) END AS changed,
  CASE WHEN isold AND pub THEN 'breaking' WHEN isnew OR isold THEN 'info' WHEN pub AND ds THEN 'breaking' WHEN dq OR dh THEN 'risk' ELSE 'info' END AS severity,
  CASE WHEN isold AND pub THEN 'public symbol removed' WHEN isnew OR isold THEN '' WHEN pub AND ds THEN 'public signature changed' WHEN dq THEN 'logical name changed' WHEN dh THEN 'implementation semantics changed' ELSE '' END AS reasons
  FROM j WHERE isnew OR isold OR dq OR ds OR dh)"""

ORACLE = {
    "node_filter_page": f"WITH {VIEWS_SQL} SELECT snapshot_id, node_id AS id, name FROM v_nodes WHERE kind = 'function' AND language = 'python' AND visibility = 'public' ORDER BY snapshot_id || '/' || node_id LIMIT 51",
    "keyset_page_2": f"""WITH {GRAPH_SQL} SELECT id, "from", "to" FROM g_edges WHERE kind = 'calls' AND {_NORM} = 'compiler_resolved' AND id > 'c:5' ORDER BY id LIMIT 101""",
    "diagnostic_filter": f"WITH {VIEWS_SQL} SELECT diagnostic_id, code FROM v_diagnostics WHERE severity = 'warning' AND stage = 'extract'",
    "artifact_list": f"WITH {VIEWS_SQL} SELECT status, count(*) AS n FROM v_artifacts WHERE language = 'go' AND starts_with(path, 'src/') GROUP BY status",
    "snapshot_page": "SELECT DISTINCT snapshot_id, created_at FROM snapshots WHERE created_at < TIMESTAMP '2025-08-05' OR (created_at = TIMESTAMP '2025-08-05' AND snapshot_id > '') OR created_at IS NULL ORDER BY created_at DESC NULLS LAST, snapshot_id LIMIT 41",
    "facets": f"""WITH {VIEWS_SQL}, {GRAPH_SQL}
SELECT 'language' AS facet, language AS value, count(*) AS n FROM v_artifacts WHERE coalesce(language, '') <> '' GROUP BY 2 UNION ALL SELECT 'node_kind', kind, count(*) FROM v_nodes GROUP BY 2
UNION ALL SELECT 'edge_resolution', {_NORM}, count(*) FROM g_edges GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM v_diagnostics GROUP BY 2""",
    "stable_ids": f"WITH {VIEWS_SQL} SELECT snapshot_id, path, 'rec:artifact:' || substr(sha256('artifact' || chr(0) || snapshot_id || chr(0) || path), 1, 24) AS stable_id FROM v_artifacts",
    "content_ids": "SELECT 'sha256:' || sha256(text) AS content_id, count(*) AS files, max(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END) AS lines FROM documents GROUP BY 1",
    "row_digests": f"WITH {VIEWS_SQL} SELECT snapshot_id, node_id AS id, sha256({_FIELD.format('kind')} || ',' || {_FIELD.format('name')} || ',' || {_FIELD.format('qualified_name')}) AS digest FROM v_nodes",
    "path_parts": r"""SELECT doc_id, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]*$')) AS ending, regexp_replace(regexp_replace(lower(trim(path)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(CASE WHEN trim(lang) <> '' THEN lang END, 'none') AS lang FROM documents""",
    "coverage_row": f"WITH {VIEWS_SQL}, {GRAPH_SQL}, {_COVERAGE_SQL} SELECT * FROM cov",
    "status_counts": f"WITH {VIEWS_SQL} SELECT trim(coalesce(status, '')) AS status, count(*) AS n FROM v_artifacts GROUP BY 1",
    "quality_gates": f"""WITH {VIEWS_SQL}, {GRAPH_SQL}, {_COVERAGE_SQL}, dg AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'fatal') AS f FROM v_diagnostics)
SELECT array_to_string(list_sort(list_filter([CASE WHEN inventory_ratio + 1e-12 < 1 THEN 'inventory' END, CASE WHEN text_artifacts > 0 AND syntactic_ratio + 1e-12 < 0.2 THEN 'syntactic' END, CASE WHEN text_artifacts > 0 AND semantic_ratio + 1e-12 < 0 THEN 'semantic' END,
  CASE WHEN symbols_total > 0 AND symbol_evidence_ratio + 1e-12 < 1 THEN 'symbol_evidence' END, CASE WHEN public_symbols > 0 AND public_documentation_ratio + 1e-12 < 0.5 THEN 'public_documentation' END, CASE WHEN edges_total > 0 AND edge_resolution_ratio + 1e-12 < 0.9 THEN 'edge_resolution' END,
  CASE WHEN claims_total > 0 AND claim_citation_ratio + 1e-12 < 1 THEN 'claim_citation' END, CASE WHEN e > 0 THEN 'errors' END, CASE WHEN f > 0 THEN 'fatal' END, CASE WHEN high_confidence_secrets > 0 THEN 'secrets' END], lambda x: x IS NOT NULL)), ',') AS failures FROM cov, dg""",
    "duplicate_ids": "SELECT 'DUPLICATE_ARTIFACT_ID' AS code, 'error' AS severity, snapshot_id || '/' || artifact_id AS subject FROM artifacts GROUP BY snapshot_id, artifact_id HAVING count(*) > 1",
    "edge_rules": f"""WITH {GRAPH_SQL}, lost AS (SELECT id || '|lost' AS id FROM g_edges WHERE kind = 'contains')
SELECT c AS code, 'error' AS severity, id AS subject FROM lost, (SELECT unnest(['UNKNOWN_RESOLUTION', 'BAD_EDGE_CONFIDENCE', 'EDGE_TARGET_MISSING']) AS c)""",
    "dangling_references": f"""WITH {VIEWS_SQL}, k AS (SELECT lower(trim(snapshot_id)) || '/' || artifact_id AS id FROM v_artifacts),
n AS (SELECT lower(trim(snapshot_id)) || '/' || node_id AS id, lower(trim(snapshot_id)) || CASE WHEN artifact_id IS NULL THEN '' ELSE '/' || artifact_id END AS a, start_line, end_line, name FROM v_nodes),
d AS (SELECT lower(trim(snapshot_id)) || '/' || diagnostic_id AS id, lower(trim(snapshot_id)) || '/' || artifact_id AS a FROM v_diagnostics)
SELECT 'NODE_ARTIFACT_MISSING' AS code, 'error' AS severity, id AS subject FROM n WHERE a NOT IN (SELECT id FROM k) UNION SELECT 'DIAGNOSTIC_ARTIFACT_MISSING', 'error', id FROM d WHERE a IS NOT NULL AND a NOT IN (SELECT id FROM k)
UNION SELECT 'BAD_NODE_RANGE', 'error', id FROM n WHERE start_line < 1 OR end_line < start_line UNION SELECT 'EMPTY_NODE_NAME', 'error', id FROM n WHERE trim(coalesce(name, '')) = ''
UNION SELECT 'DUPLICATE_DIAGNOSTIC_ID', 'error', id FROM d GROUP BY id HAVING count(*) > 1 UNION SELECT 'DUPLICATE_NODE_ID', 'error', id FROM n GROUP BY id HAVING count(*) > 1""",
    "merge_artifact_rows": f"SELECT snapshot_id || '/' || artifact_id AS id, status, path FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, artifact_id ORDER BY -({_STATUS_RANK}), received_at, status, path) AS rn FROM artifacts) WHERE rn = 1",
    "merge_edge_rows": f"""WITH r AS (SELECT 'rec:edge:' || substr(sha256('edge' || chr(0) || 'consumes' || chr(0) || l_partkey || chr(0) || l_suppkey), 1, 24) AS id, CAST(l_partkey AS VARCHAR) AS f, CAST(l_suppkey AS VARCHAR) AS t,
  CASE WHEN l_returnflag = 'R' THEN 'unresolved' WHEN l_linestatus = 'O' THEN 'declared' ELSE 'observed' END AS resolution, round(l_discount, 4) AS confidence, l_orderkey, l_linenumber, l_discount, l_returnflag FROM lineitem)
SELECT id, 'consumes' AS kind, f AS "from", t AS "to", resolution, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -({_RES_RANK}), l_orderkey, l_linenumber, l_discount, l_returnflag, resolution, confidence) AS rn FROM r) WHERE rn = 1""",
    "logical_entities": f"""WITH {VIEWS_SQL}, s AS (SELECT snapshot_id, max(created_at) AS tm FROM snapshots GROUP BY 1), seen AS (SELECT DISTINCT logical_id, snapshot_id, tm FROM v_nodes JOIN s USING (snapshot_id) WHERE coalesce(logical_id, '') <> '')
SELECT logical_id, first(snapshot_id ORDER BY tm, snapshot_id) AS first_snapshot, last(snapshot_id ORDER BY tm, snapshot_id) AS last_snapshot FROM seen GROUP BY logical_id""",
    "ranks": f"""WITH {VIEWS_SQL}, {GRAPH_SQL} SELECT 'node' AS what, (kind IN {_SYMBOLS}) || '/' || {_PUBLIC} AS value, count(*) AS n FROM v_nodes GROUP BY 2 UNION ALL SELECT 'artifact', CAST({_STATUS_RANK} AS VARCHAR), count(*) FROM v_artifacts GROUP BY 2
UNION ALL SELECT 'edge', {_NORM} || '/' || ({_RES_RANK}), count(*) FROM g_edges GROUP BY 2""",
    "semantic_diff": f"WITH {_DIFF_SQL} SELECT * FROM nd",
    "diff_summary": f"""WITH {GRAPH_SQL}, {_DIFF_SQL},
eb AS (SELECT id, {_NORM} AS r, confidence FROM g_edges), ea AS (SELECT id, CASE WHEN resolution = 'Resolved' THEN 'compiler_resolved' WHEN confidence = 0.4 THEN 'unresolved' ELSE {_NORM} END AS r FROM g_edges WHERE confidence <> 0.3),
pb AS (SELECT p_name AS k, p_brand AS v, p_type AS l, p_partkey AS s FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1),
pa AS (SELECT p_name AS k, CASE WHEN p_partkey % 13 = 0 THEN 'new' ELSE p_brand END AS v, p_type AS l FROM part WHERE p_partkey % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1),
pj AS (SELECT pb.k AS b, pa.k AS a, coalesce(pb.v <> pa.v OR pb.l <> pa.l, false) AS m FROM pb FULL OUTER JOIN pa ON pa.k = pb.k)
SELECT (SELECT count(*) FROM pj WHERE b IS NULL) AS artifacts_added, (SELECT count(*) FROM pj WHERE a IS NULL) AS artifacts_removed, (SELECT count(*) FROM pj WHERE m) AS artifacts_modified,
  (SELECT count(*) FROM nd WHERE change_kind = 'added') AS nodes_added, (SELECT count(*) FROM nd WHERE change_kind = 'removed') AS nodes_removed, (SELECT count(*) FROM nd WHERE change_kind = 'modified') AS nodes_modified,
  0::BIGINT AS edges_added, (SELECT count(*) FROM eb WHERE confidence = 0.3) AS edges_removed, (SELECT count(*) FROM eb JOIN ea USING (id) WHERE eb.r <> ea.r) AS edges_modified,
  (SELECT count(*) FROM nd WHERE severity = 'breaking') AS breaking, (SELECT count(*) FROM nd WHERE severity = 'risk') AS risk""",
}

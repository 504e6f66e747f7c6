"""Retrieval and graph queries over the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.search_index import Engine
from ..sources.tables import table
from . import views
from .views import GRAPH_SQL

_TEXT = "stale registry mergeBudget snapshot"


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: field-boosted BM25 over all documents."""
    return views.lexical_index(spark, folder).search(R.Query(_TEXT, limit=50)).select("id", "score", F.concat_ws(",", "terms").alias("terms"), F.concat_ws(",", "reasons").alias("reasons"))


def bm25_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """With inline filters and an exact title."""
    q = R.Query("README.md lang:markdown path:README", limit=20)
    return views.lexical_index(spark, folder).search(q).select("id", "score", F.concat_ws(",", "reasons").alias("reasons"))


def fulltext_topk(spark: SparkSession, folder: str) -> DataFrame:
    return views.fulltext_index(spark, folder).fulltext(R.Query("ledger outline", limit=25)).select("id", "score")


def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and total count of every term."""
    return views.lexical_index(spark, folder).terms()


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.index_stats(views.search_docs(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    v = _vectors(spark, folder)
    return R.dense_topk(v, v.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id"), 10)


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that aren't of unit length, of all and of a scaled copy."""
    v = _vectors(spark, folder)
    scaled = v.select((F.col("id") + 1_000_000).alias("id"), F.transform("embedding", lambda x: (x * 1.5).cast("float")).alias("embedding"))
    return R.unit_norm_violations(v.unionByName(scaled)).select("id", F.round("norm", 4).alias("norm"))


def rrf_topk(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 hits and the neighbours of one vector, fused."""
    lex = bm25_topk(spark, folder).select("id", "score")
    v = _vectors(spark, folder)
    sem = R.dense_topk(v, v.where("id = 100").withColumnRenamed("id", "query_id"), 40).select(F.col("id").cast("string").alias("id"), "score")
    order = [F.desc("score"), F.col("id")]
    return R.fuse([R.channel_ranks(lex, order, "lexical"), R.channel_ranks(sem, order, "semantic")], 60).select("id", "score", F.concat_ws(",", "reasons").alias("reasons"))


def multi_query_merge(spark: SparkSession, folder: str) -> DataFrame:
    index = views.lexical_index(spark, folder)
    parts = []
    for text in ("ledger outline", "outline budget", "deep channel"):
        hits = index.search(R.Query(text, limit=30))
        parts.append(hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "reasons"))
    return R.merge_responses(parts, 50).select("id", F.round("score", 9).alias("score"), F.size("reasons").cast("bigint").alias("n_reasons"))


def _engine(spark: SparkSession, folder: str) -> Engine:
    """Search whose queries' vectors are those of document 100, for want of a model."""
    index = views.vector_index(spark, folder)
    return Engine(views.lexical_index(spark, folder), index, lambda text: index.vectors.where("id = '100'").first().embedding)


def _answer(found: R.Response) -> DataFrame:
    return found.hits.select("id", "score", F.concat_ws(",", "reasons").alias("reasons"), F.lit(found.mode).alias("mode"), F.lit(found.truncated).alias("truncated"))


def search_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return _answer(_engine(spark, folder).search(R.Query(_TEXT, limit=20), "lexical"))


def search_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest Markdown documents."""
    return _answer(_engine(spark, folder).search(R.Query(_TEXT, languages=("markdown",), limit=20), "semantic"))


def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _answer(_engine(spark, folder).search(R.Query(_TEXT, limit=20), "hybrid"))


def graph_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Three hits spread over their neighbours."""
    hits = spark.createDataFrame([("s:1", 3.0, True), ("n:3", 2.0, True), ("c:7", 1.0, False)], "id string, score double, is_node boolean")
    return R.expand(hits, views.edge_index(spark, folder), views.graph_nodes(spark, folder), 2, 1000, budget=5000).hits.select("id", "score", F.concat_ws(",", "reasons").alias("reasons"))


def neighborhood(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by their distance from one customer, within three steps."""
    n = G.neighborhood(views.edge_index(spark, folder), "c:1", G.Options(depth=3, capped=False))
    return n.nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def neighborhood_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first 400 nodes about a nation in the order of their discovery, and whether there are more."""
    n = G.neighborhood(views.edge_index(spark, folder), "n:3", G.Options(depth=2, nodes=400))
    return n.nodes.select("id", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), F.lit(n.truncated).alias("truncated"))


def neighborhood_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of a customer's neighbourhood of two steps."""
    n = G.neighborhood(views.edge_index(spark, folder), "c:1", G.Options(depth=2, capped=False))
    return n.edges.select("id", F.col("from").alias("source"), F.col("to").alias("target"))


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """What leads to a nation within two steps, against the direction of the edges."""
    n = G.impact(views.edge_index(spark, folder), "n:3", G.Options(direction="incoming", depth=2, capped=False))
    return n.nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """The length and the ends of a path between a region and a part."""
    p = G.shortest_path(views.edge_index(spark, folder), "r:0", "s:2", G.Options(depth=8, capped=False))
    return spark.createDataFrame([(p.found, len(p.edges), p.nodes[0] if p.nodes else "", p.nodes[-1] if p.nodes else "")], "found boolean, length bigint, first string, last string")


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = e.withColumn("to", F.lead("event_type").over(w)).where(F.col("to").isNotNull())
    return after.select(F.col("event_type").alias("from"), "to", F.lit("calls").alias("kind")).distinct()


def scc_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return G.strongly_connected(_transitions(spark, folder))


def scc_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rings among the parent links of snapshots."""
    from .lineage import snapshot_links

    links = snapshot_links(spark, folder).where(F.col("parent").isNotNull()).select(F.col("id").alias("from"), F.col("parent").alias("to"), F.lit("derived_from").alias("kind"))
    return G.strongly_connected(links).where("cyclic")


def degree_detail(spark: SparkSession, folder: str) -> DataFrame:
    return G.incident(views.graph_nodes(spark, folder), views.graph_edges(spark, folder))


def induced_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between regions, nations, customers and suppliers."""
    some = views.graph_nodes(spark, folder).where(F.col("kind").isin("namespace", "module", "class"))
    return G.induced(views.graph_edges(spark, folder), some).select("id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_filtered, fulltext_topk, index_terms, index_stats, dense_topk, vector_norms, rrf_topk, multi_query_merge, search_lexical, search_semantic, search_hybrid, graph_expand, neighborhood, neighborhood_order, neighborhood_edges, impact, shortest_path, scc_transitions, scc_snapshots, degree_detail, induced_subgraph,
    )
}


def _tokens(c: str) -> str:
    camel = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(.)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_filter(list_transform(regexp_extract_all({camel}, '[\p{{L}}\p{{Nd}}_]+'), lambda t: lower(t)), lambda t: octet_length(encode(t)) > 1 OR regexp_matches(t, '^\p{{Nd}}'))"


_BOOST = {"id": 3, "title": 8, "qualified_name": 7, "signature": 6, "path": 4, "kind": 2, "language": 2, "body": 1}


def _index(fields: dict[str, int]) -> str:
    base = "sdocs AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'document' AS object_type, lower(trim(coalesce(source, ''))) AS kind, coalesce(lang, '') AS language, regexp_extract(path, '[^/]*$') AS title, path AS qualified_name, '' AS signature, path, coalesce(text, '') AS body FROM documents)"
    tok = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {b}.0 AS boost, unnest({_tokens(f)}) AS term FROM sdocs" for f, b in fields.items())
    return f"{base}, tok AS ({tok}), post AS (SELECT id, term, count(*) AS tf, max(boost) AS boost, list_sort(list_distinct(list(field))) AS fields FROM tok GROUP BY id, term), len AS (SELECT sdocs.id, count(tok.term) AS l FROM sdocs LEFT JOIN tok ON tok.id = sdocs.id GROUP BY sdocs.id), st AS (SELECT count(*) AS n, avg(l) AS av FROM len)"


def _bm25(terms: list[str], where: str = "true") -> str:
    some = ", ".join(f"'{t}'" for t in terms)
    return f"""df AS (SELECT term, count(*) AS df FROM post WHERE term IN ({some}) GROUP BY term),
sc AS (SELECT p.id, p.term, p.fields, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / av)) * boost AS s FROM post p JOIN df USING (term) JOIN len USING (id) JOIN sdocs USING (id), st WHERE {where}),
sums AS (SELECT id, sum(s) AS score, list_sort(list(term)) AS terms, flatten(list(list_transform(fields, lambda f: f || ':' || term))) AS why FROM sc GROUP BY id)"""


def _bonus(text: str) -> str:
    value = lambda f: f"array_to_string({_tokens(f)}, ' ')"
    plus = " + ".join(f"CASE WHEN {value(f)} = '{text}' THEN 100 WHEN starts_with({value(f)}, '{text}') THEN 12 ELSE 0 END" for f in ("title", "qualified_name", "signature", "path", "id"))
    why = ", ".join(f"CASE WHEN {value(f)} = '{text}' THEN 'exact_{f}' WHEN starts_with({value(f)}, '{text}') THEN 'prefix_{f}' END" for f in ("title", "qualified_name", "signature", "path", "id"))
    return f"hits AS (SELECT id, round((score + {plus}) * 1000000) / 1000000 AS score, terms, list_sort(list_concat(why, list_filter([{why}], lambda x: x IS NOT NULL))) AS reasons, qualified_name FROM sums JOIN sdocs USING (id))"


_LEX = f"WITH {_index(_BOOST)}, {_bm25(['stale', 'registry', 'merge', 'budget', 'snapshot'])}, {_bonus('stale registry merge budget snapshot')}"


def _plain(text: str, name: str, limit: int) -> str:
    """One lexical search as its own chain of tables, ranked by (score, id)."""
    t = f"{_bm25(text.split())}, {_bonus(text)}"
    for w in ("df", "sc", "sums", "hits"):
        t = t.replace(f"{w} AS (", f"{w}_{name} AS (").replace(f"JOIN {w} ", f"JOIN {w}_{name} ").replace(f"FROM {w} ", f"FROM {w}_{name} ")
    return f"{t}, top_{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM hits_{name} ORDER BY score DESC, qualified_name || chr(0) || id LIMIT {limit + 1}))"


_UNIT = "list_transform(embedding, lambda x: CAST(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT))"
_NEAR = f"""unit AS (SELECT vec_id, {_UNIT} AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(v.e, lambda x: CAST(x AS DOUBLE))) * 1000000) / 1000000 AS score FROM unit q, unit v WHERE q.vec_id % 100 = 0)"""
_OK = "lower(trim(resolution)) <> 'unresolved'"


def _bfs(seed: str, depth: int, both: bool) -> str:
    moves = f"""SELECT "to" AS a, "from" AS b FROM g_edges WHERE {_OK}""" + (f""" UNION ALL SELECT "from", "to" FROM g_edges WHERE {_OK}""" if both else "")
    return f"WITH RECURSIVE {GRAPH_SQL}, mv AS ({moves}), walk AS (SELECT '{seed}' AS id, 0::BIGINT AS depth UNION SELECT b, depth + 1 FROM walk JOIN mv ON a = walk.id WHERE depth < {depth})"


ORACLE = {
    "bm25_topk": f"{_LEX} SELECT id, score, array_to_string(terms, ',') AS terms, array_to_string(reasons, ',') AS reasons FROM hits ORDER BY score DESC, qualified_name || chr(0) || id LIMIT 51",
    "bm25_filtered": f"WITH {_index(_BOOST)}, {_bm25(['readme', 'md'], "language = 'markdown' AND starts_with(path, 'README')")}, {_bonus('readme md')} SELECT id, score, array_to_string(reasons, ',') AS reasons FROM hits ORDER BY score DESC, qualified_name || chr(0) || id LIMIT 21",
    "fulltext_topk": f"WITH {_index({'title': 8, 'qualified_name': 7, 'signature': 6, 'body': 1})}, {_bm25(['ledger', 'outline'])} SELECT id, round(score * 1000000) / 1000000 AS score FROM sums ORDER BY 2 DESC, id LIMIT 101",
    "index_terms": f"WITH {_index(_BOOST)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(max(boost) AS DOUBLE) AS boost FROM post GROUP BY term",
    "index_stats": f"WITH {_index(_BOOST)} SELECT n AS documents, CAST((SELECT sum(l) FROM len) AS BIGINT) AS tokens, (SELECT sum(l) FROM len) / n AS average FROM st",
    "dense_topk": f"WITH {_NEAR} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 10",
    "vector_norms": "SELECT vec_id + 1000000 AS id, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(CAST(y * 1.5 AS FLOAT) AS DOUBLE) * CAST(y * 1.5 AS FLOAT)))), 4) AS norm FROM embeddings",
    "rrf_topk": f"""{_LEX}, {_NEAR}, lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 'lexical' AS channel FROM (SELECT id, score FROM hits ORDER BY score DESC, qualified_name || chr(0) || id LIMIT 51)),
sm AS (SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank, 'semantic' AS channel FROM (SELECT * FROM near WHERE query_id = 100 ORDER BY score DESC, id LIMIT 40))
SELECT id, round(sum(1.0 / (60 + rank)) * 1000000) / 1000000 AS score, array_to_string(list_sort(list(channel || '_rank:' || rank)), ',') AS reasons FROM (SELECT * FROM lx UNION ALL SELECT * FROM sm) GROUP BY id ORDER BY score DESC, id LIMIT 60""",
    "search_lexical": f"""{_LEX}, top AS (SELECT * FROM hits ORDER BY score DESC, qualified_name || chr(0) || id LIMIT 80) SELECT id, score, array_to_string(reasons, ',') AS reasons, 'lexical' AS mode, (SELECT count(*) FROM hits) > 20 AS truncated FROM top ORDER BY score DESC, qualified_name || chr(0) || id LIMIT 20""",
    "search_semantic": f"""WITH {_NEAR}, hits AS (SELECT CAST(n.id AS VARCHAR) AS id, n.score FROM near n JOIN documents d ON d.doc_id = n.id WHERE n.query_id = 100 AND d.lang = 'markdown')
SELECT id, score, 'dense_cosine' AS reasons, 'semantic' AS mode, (SELECT count(*) FROM hits) > 20 AS truncated FROM hits ORDER BY score DESC, id LIMIT 20""",
    "search_hybrid": f"""{_LEX}, {_NEAR}, lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, qualified_name || chr(0) || id) AS rank, 'lexical' AS channel FROM hits QUALIFY rank <= 80),
sm AS (SELECT CAST(n.id AS VARCHAR) AS id, row_number() OVER (ORDER BY n.score DESC, CAST(n.id AS VARCHAR)) AS rank, 'semantic' AS channel FROM near n JOIN documents d ON d.doc_id = n.id WHERE n.query_id = 100 QUALIFY rank <= 80),
fused AS (SELECT id, round(sum(1.0 / (60 + rank)) * 1000000) / 1000000 AS score, array_to_string(list_sort(list(channel || '_rank:' || rank)), ',') AS reasons FROM (SELECT * FROM lx UNION ALL SELECT * FROM sm) GROUP BY id)
SELECT id, score, reasons, 'hybrid-rrf' AS mode, (SELECT count(*) FROM fused) > 20 AS truncated FROM fused ORDER BY score DESC, id LIMIT 20""",
    "multi_query_merge": f"""WITH {_index(_BOOST)}, {_plain('ledger outline', 'a', 30)}, {_plain('outline budget', 'b', 30)}, {_plain('deep channel', 'c', 30)}
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(len(list_distinct(flatten(list(list_append(reasons, 'q' || q))))) AS BIGINT) AS n_reasons FROM (SELECT *, 0 AS q FROM top_a UNION ALL SELECT *, 1 FROM top_b UNION ALL SELECT *, 2 FROM top_c) GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 50""",
    "graph_expand": f"""WITH {GRAPH_SQL}, mv AS (SELECT DISTINCT * FROM (SELECT "from" AS a, "to" AS b FROM g_edges WHERE {_OK} UNION ALL SELECT "to", "from" FROM g_edges WHERE {_OK})),
h AS (SELECT * FROM (VALUES ('s:1', 3.0::DOUBLE, 1, true), ('n:3', 2.0, 2, true), ('c:7', 1.0, 3, false)) t(id, score, ord, is_node)),
d0 AS (SELECT id AS seed, id, score AS sc, ord, 0 AS depth, 1::BIGINT AS rk FROM h WHERE is_node),
d1 AS (SELECT seed, b AS id, sc, ord, 1 AS depth, row_number() OVER (PARTITION BY seed ORDER BY b) AS rk FROM d0 JOIN mv ON a = id WHERE b <> seed),
c2 AS (SELECT seed, b AS id, any_value(sc) AS sc, any_value(ord) AS ord, min(rk) AS prank FROM d1 JOIN mv ON a = id WHERE b <> seed GROUP BY seed, b),
d2 AS (SELECT seed, id, sc, ord, 2 AS depth, row_number() OVER (PARTITION BY seed ORDER BY prank, id) AS rk FROM c2 WHERE NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = c2.seed AND x.id = c2.id)),
every AS (SELECT *, row_number() OVER (ORDER BY ord, depth, rk) AS used FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)),
gn AS (SELECT id, sum(sc * 0.55 ** depth) AS bonus, list_sort(list_distinct(list('graph_from:' || seed || ':depth:' || depth))) AS reasons FROM every WHERE used <= 5000 AND depth > 0 AND id IN (SELECT id FROM g_nodes) GROUP BY id)
SELECT coalesce(h.id, gn.id) AS id, round((coalesce(score, 0) + coalesce(bonus, 0)) * 1000000) / 1000000 AS score, coalesce(array_to_string(reasons, ','), '') AS reasons FROM h FULL OUTER JOIN gn ON h.id = gn.id ORDER BY 2 DESC, 1 LIMIT 1000""",
    "neighborhood_order": f"""WITH {GRAPH_SQL}, mv AS (SELECT DISTINCT * FROM (SELECT "from" AS a, "to" AS b FROM g_edges WHERE {_OK} UNION ALL SELECT "to", "from" FROM g_edges WHERE {_OK})),
d1 AS (SELECT b AS id, row_number() OVER (ORDER BY b) AS rk FROM mv WHERE a = 'n:3' AND b <> 'n:3'), c2 AS (SELECT b AS id, min(rk) AS prank FROM d1 JOIN mv ON a = id WHERE b <> 'n:3' AND b NOT IN (SELECT id FROM d1) GROUP BY b),
every AS (SELECT 'n:3' AS id, 0 AS depth, 0::BIGINT AS rk UNION ALL SELECT id, 1, rk FROM d1 UNION ALL SELECT id, 2, (SELECT count(*) FROM d1) + row_number() OVER (ORDER BY prank, id) FROM c2)
SELECT id, depth::BIGINT AS depth, rk AS rank, (SELECT count(*) FROM every) > 400 AS truncated FROM every WHERE rk < 400""",
    "neighborhood_edges": f"""{_bfs('c:1', 2, True)}, v AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT e.id, e."from" AS source, e."to" AS target FROM g_edges e JOIN v a ON a.id = e."from" JOIN v b ON b.id = e."to" WHERE {_OK} AND least(a.depth, b.depth) < 2""",
    "neighborhood": f"{_bfs('c:1', 3, True)} SELECT id, min(depth) AS depth FROM walk GROUP BY id",
    "impact": f"{_bfs('n:3', 2, False)} SELECT id, min(depth) AS depth FROM walk WHERE id <> 'n:3' GROUP BY id",
    "shortest_path": f"{_bfs('r:0', 6, True)} SELECT true AS found, min(depth) AS length, 'r:0' AS first, 's:2' AS last FROM walk WHERE id = 's:2'",
    "scc_transitions": """WITH RECURSIVE t AS (SELECT DISTINCT event_type AS a, b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL),
r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a), v AS (SELECT a AS id FROM t UNION SELECT b FROM t), m AS (SELECT v.id, least(v.id, min(r.b)) AS component FROM v LEFT JOIN r ON r.a = v.id AND EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = r.a) GROUP BY v.id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size, count(*) OVER (PARTITION BY component) > 1 OR EXISTS (SELECT 1 FROM t WHERE t.a = m.id AND t.b = m.id) AS cyclic FROM m""",
    "degree_detail": f"""WITH {GRAPH_SQL}, i AS (SELECT "to" AS id, count(*) AS n_in FROM g_edges GROUP BY 1), o AS (SELECT "from" AS id, count(*) AS n_out FROM g_edges GROUP BY 1) SELECT g.id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM g_nodes g LEFT JOIN i USING (id) LEFT JOIN o USING (id)""",
    "induced_subgraph": f"""WITH {GRAPH_SQL}, s AS (SELECT id FROM g_nodes WHERE kind IN ('namespace', 'module', 'class')) SELECT id, kind FROM g_edges WHERE "from" IN (SELECT id FROM s) AND "to" IN (SELECT id FROM s)""",
}


def _snapshot_rings() -> str:
    from .lineage import _WALK_SQL

    return f"""{_WALK_SQL}, comp AS (SELECT start AS id, min(spot) AS component, count(DISTINCT spot) AS size FROM walk WHERE start IN (SELECT id FROM ring) AND spot IN (SELECT id FROM ring) GROUP BY start)
SELECT id, component, size, true AS cyclic FROM comp"""


ORACLE["scc_snapshots"] = _snapshot_rings()

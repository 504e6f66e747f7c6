import pytest
from pyspark.sql import functions as F

from strataloom.functions.text import tokenize
from strataloom.operators import retrieval as R
from strataloom.operators.text_rules import tokens

DOCS = [
    ("n1", "node", "function", "go", "GraphSearch", "internal/search.GraphSearch", "func GraphSearch()", "internal/search/index.go", "searches the graph"),
    ("n2", "node", "method", "go", "SearchGraph", "internal/graph.SearchGraph", "func SearchGraph()", "internal/graph/index.go", "graph"),
    ("a1", "artifact", "file", "go", "index.go", "internal/search/index.go", "", "internal/search/index.go", "text/x-go text"),
    ("d1", "document", "guide", "", "Guide", "docs/guide.md", "", "docs/guide.md", "How to search"),
]
SCHEMA = "id string, object_type string, kind string, language string, title string, qualified_name string, signature string, path string, body string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_lexical(docs):
    top = R.lexical_search(docs, R.Query("GraphSearch")).collect()
    assert top[0].id == "n1" and {"exact_title", "title:graph"} <= set(top[0].reasons)
    assert "prefix_path" in R.lexical_search(docs, R.Query("internal/search")).first().reasons
    assert R.lexical_search(docs, R.Query("graph graph")).first().terms == ["graph"]
    assert ids(R.lexical_search(docs, R.Query("graph kind:function lang:go type:node path:internal/"))) == ["n1"]
    assert ids(R.lexical_search(docs, R.Query("graph kind:function", kinds=("method",)))) == ["n2"]
    assert ids(R.lexical_search(docs, R.Query("kind:function"))) == []
    assert ids(R.fulltext_search(docs, R.Query("guide search")))[0] in ("d1", "n1", "n2")


def test_limits(spark):
    tied = spark.range(1002).select(F.format_string("id-%04d", "id").alias("id"), F.lit("node").alias("object_type"), F.lit("k").alias("kind"), F.lit("go").alias("language"), F.lit("same").alias("title"), F.lit("").alias("qualified_name"), F.lit("").alias("signature"), F.lit("").alias("path"), F.lit("").alias("body"))
    two = R.lexical_search(tied, R.Query("same", limit=2)).collect()
    assert [r.id for r in two] == ["id-0000", "id-0001", "id-0002"]  # one more tells that there are more
    assert R.lexical_search(tied, R.Query("same")).count() == 51
    assert R.lexical_search(tied, R.Query("same", limit=5000)).count() == 1001
    assert R.lexical_search(tied.limit(0), R.Query("same")).collect() == []


def test_tokens_agree(spark):
    texts = ["GraphSearchIndex", "HTTPServer_v2", "a é x9 9x ß", "ÜberGroß", "snake_case CamelCase", "", "日本語 text", "A B2C iOSApp", None, "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: tokens(t or "") for t in texts}


def test_dense_and_fusion(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0]), ("bad", [0.0, 0.0])], "query_id string, embedding array<float>")
    got = [(r.query_id, r.id, r.score, r.rank) for r in R.dense_topk(v, q, 3).orderBy("rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "b", 0.8, 2), ("q", "c", 0.0, 3)]
    assert R.dense_topk(v, q.limit(0), 3).collect() == []
    lex = spark.createDataFrame([("a", 1, "lexical"), ("c", 2, "lexical"), ("", 3, "lexical")], "id string, rank int, channel string")
    sem = spark.createDataFrame([("a", 1, "semantic"), ("b", 2, "semantic")], "id string, rank int, channel string")
    fused = R.fuse([lex, sem], 10).collect()
    assert [r.id for r in fused] == ["a", "b", "c"] and fused[0].reasons == ["lexical_rank:1", "semantic_rank:1"]
    assert {r.id for r in R.unit_norm_violations(v.where("id in ('a', 'b', 's', 'z')")).collect()} == {"z"}


def test_merge_responses(spark):
    one = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"])], "id string, rank int, reasons array<string>")
    two = spark.createDataFrame([("b", 1, ["z"]), (" ", 2, ["w"])], "id string, rank int, reasons array<string>")
    got = R.merge_responses([one, two], 5).collect()
    assert [r.id for r in got] == ["b", "a"] and got[0].reasons == ["verification_query:0", "verification_query:1", "y", "z"]


def test_expand(spark):
    hits = spark.createDataFrame([("a", 2.0, True), ("x", 1.0, False)], "id string, score double, is_node boolean")
    edges = spark.createDataFrame([("ab", "calls", "a", "b", "declared"), ("bc", "calls", "c", "b", "declared"), ("bu", "calls", "b", "u", "unresolved")], "id string, kind string, `from` string, `to` string, resolution string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("u",), ("x",)], "id string")
    got = {r.id: (r.score, r.reasons) for r in R.expand(hits, edges, docs, 2, 10).hits.collect()}
    assert got == {"a": (2.0, []), "b": (1.1, ["graph_from:a:depth:1"]), "c": (0.605, ["graph_from:a:depth:2"]), "x": (1.0, [])}
    assert set(ids(R.expand(hits, edges, docs, 2, 10, budget=2).hits)) == {"a", "b", "x"}


def test_parsing_and_repair(spark):
    q = R.parse_query(R.Query("find kind:a x:y LANG:go path:p/q", types=("t",)))
    assert q == R.Query("find x:y", ("a",), ("go",), ("t",), "p/q", 0)
    assert R.repair_queries(["a:b\\c", "A b  C", "", "\x00", "z" * 600]) == ["a b c", "z" * 512]
    whole = spark.createDataFrame([("1", "node", "k", "go", "é" * 40, "", "", "", "b")], SCHEMA).select(R.embedding_text(70).alias("t")).first().t
    assert len(whole.encode()) in (69, 70) and whole.startswith("object_type: node\nkind: k\n")
    n = spark.createDataFrame([("1", "function", "f", "b.f", True, "", ["e"]), ("2", "secret", "s", "a.s", True, "", ["e"]), ("3", "class", "c", "", True, "", ["e"]), ("4", "class", "c", "", False, "public", [])], "id string, kind string, name string, qualified_name string, public_surface boolean, visibility string, evidence_ids array<string>")
    assert ids(R.synthesis_subjects(n, 5)) == ["1", "3"]


def test_documents(spark):
    a = spark.createDataFrame([("art", "file", "go", "x/y.go", "text/x-go", "text")], "id string, kind string, language string, path string, media_type string, status string")
    assert R.artifact_documents(a).first().asDict() == {"id": "art", "object_type": "artifact", "kind": "file", "language": "go", "title": "y.go", "qualified_name": "x/y.go", "signature": "", "path": "x/y.go", "body": "text/x-go text"}
    n = spark.createDataFrame([("n", "function", "go", "f", "p.f", "f()", "art", None, {"summary": "s", "docstring": "d", "purpose": ""})], "id string, kind string, language string, name string, qualified_name string, signature string, artifact_id string, source_path string, attributes map<string,string>")
    r = R.node_documents(n, a.withColumnRenamed("id", "artifact_id")).first()
    assert r.path == "x/y.go" and r.body == "d\ns"
    d = spark.createDataFrame([("d", "guide", "T", "p.md", [("H", "text"), ("I", None)])], "id string, kind string, title string, path string, sections array<struct<heading:string,plain_text:string>>")
    assert R.section_documents(d).first().body == "H\ntext\nI\n\n"

import pytest
from pyspark.sql import functions as F
from test_retrieval import DOCS, SCHEMA

from strataloom.operators import retrieval as R
from strataloom.operators import search_index as S

VECTORS = [("n1", [1.0, 0.0]), ("n2", [0.6, 0.8]), ("a1", [0.0, 2.0]), ("d1", [-1.0, 0.0])]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    return S.LexicalIndex.build(docs, str(tmp_path_factory.mktemp("lex")), partitions=2), docs


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vec"))
    return S.VectorIndex.build(spark.createDataFrame(VECTORS, "id string, embedding array<float>"), at, 2), at


@pytest.mark.parametrize("text", ["GraphSearch", "graph", "internal/search", "graph kind:function lang:go", "how to search path:docs", "kind:function", "", "nothing like it"])
def test_stored_search_equals_the_scan(index, text):
    stored, docs = index
    want = [(r.id, r.score, r.reasons, r.terms) for r in R.lexical_search(docs, R.Query(text, limit=3)).collect()]
    assert [(r.id, r.score, r.reasons, r.terms) for r in stored.search(R.Query(text, limit=3)).collect()] == want


def test_a_query_reads_its_terms_only(index):
    plan = index[0].search(R.Query("graph search"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [graph,search])" in plan or "In(term, [" in plan


def test_versions_and_empty_indexes(spark, index, tmp_path):
    empty = S.LexicalIndex.build(index[1].limit(0), str(tmp_path / "none"))
    assert empty.n_documents == 0 and empty.average == 1.0 and empty.search(R.Query("graph")).collect() == []
    spark.createDataFrame([("other", 1, 1, True)], "version string, n_documents bigint, n_tokens bigint, bonuses boolean").write.mode("overwrite").parquet(str(tmp_path / "none" / "stats"))
    with pytest.raises(S.VersionMismatch):
        S.LexicalIndex.load(spark, str(tmp_path / "none"))


def test_vectors(spark, index, vectors, tmp_path):
    stored, at = vectors
    hits = stored.search(index[0].documents, R.Query("", types=("node",)), [2.0, 0.0]).collect()
    assert [(r.id, r.score, r.reasons) for r in hits] == [("n1", 1.0, ["dense_cosine"]), ("n2", 0.6, ["dense_cosine"])]
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], []):
        with pytest.raises(S.BadVector):
            stored.search(index[0].documents, R.Query(""), bad)
    for rows in ([("a", [1.0]), ("b", [1.0, 2.0])], [("a", [0.0, 0.0])], [("a", None)]):
        with pytest.raises(S.BadVector):
            S.VectorIndex.build(spark.createDataFrame(rows, "id string, embedding array<float>"), str(tmp_path / "bad"))
    assert S.VectorIndex.load(spark, at, check=True).dimensions == 2
    spark.read.parquet(f"{at}/vectors").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2.0).cast("float"))).write.parquet(str(tmp_path / "long" / "vectors"))
    spark.read.parquet(f"{at}/stats").write.parquet(str(tmp_path / "long" / "stats"))
    with pytest.raises(S.BadVector):
        S.VectorIndex.load(spark, str(tmp_path / "long"), check=True)


def test_engine(spark, index, vectors):
    edges = spark.createDataFrame([("e", "calls", "n1", "d1", "declared")], "id string, kind string, `from` string, `to` string, resolution string")
    engine = S.Engine(index[0], vectors[0], lambda text: [1.0, 0.0], edges)
    lexical = engine.search(R.Query("graph", limit=1), "lexical")
    assert lexical.mode == "lexical" and lexical.truncated and lexical.hits.count() == 1
    near = engine.search(R.Query("graph"), "semantic")
    assert near.mode == "semantic" and [r.id for r in near.hits.collect()] == ["n1", "n2", "a1", "d1"] and not near.truncated
    both = engine.search(R.Query("graph")).hits.collect()
    assert {"lexical_rank:1", "semantic_rank:1"} & set(both[0].reasons) and len(both) == 4
    wide = engine.search(R.Query("GraphSearch"), "lexical", hops=1)
    assert wide.mode == "lexical+graph" and "graph_from:n1:depth:1" in {r.id: r.reasons for r in wide.hits.collect()}["d1"]
    with pytest.raises(ValueError):
        engine.search(R.Query("x"), "exact")
    with pytest.raises(ValueError):
        S.Engine(index[0]).search(R.Query("x"), "semantic")

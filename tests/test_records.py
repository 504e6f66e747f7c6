import pytest
from pyspark.sql import functions as F

from strataloom.functions.ids import content_id, row_digest, set_digest, stable_id
from strataloom.functions.text import first_filled, line_count, slugify
from strataloom.operators import coverage as C
from strataloom.operators import merge as M
from strataloom.operators import records as R
from strataloom.operators import semantic_diff as D
from strataloom.operators import validate as V


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("é", None), ("", "b")], "a string, b string")
    got = [r[0] for r in df.select(stable_id("ns", F.col("a"), F.col("b"), prefix="p")).collect()]
    want = ["p:ns:" + hashlib.sha256(f"ns\0{a}\0{b}".encode()).hexdigest()[:24] for a, b in (("é", ""), ("", "b"))]
    assert got == want
    assert df.select(stable_id("ns", prefix="p")).first()[0] == "p:ns:" + hashlib.sha256(b"ns\0").hexdigest()[:24]
    assert df.select(content_id(F.lit("x"))).first()[0] == "sha256:" + hashlib.sha256(b"x").hexdigest()
    d = lambda x: x.agg(set_digest(row_digest(F.col("a"), F.col("b"))).alias("d")).first().d
    assert d(df) == d(df.orderBy("a")) != d(df.limit(1))
    assert df.select(row_digest(F.lit(None).cast("string")) != row_digest(F.lit(""))).first()[0]


def test_text(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\nb",), ("",), (None,), ("\n",)], "t string")
    assert [r[0] for r in df.select(line_count(F.col("t"))).collect()] == [2, 2, 0, 0, 1]
    assert df.select(slugify(F.lit(" Héllo, World! "))).first()[0] == "h-llo-world"
    assert df.select(first_filled(F.lit(" "), F.lit(None), F.lit("x"))).first()[0] == "x"


def test_filters_and_pages(spark):
    e = spark.createDataFrame([(f"e{i}", "calls", "a", "b", ["resolved", "declared", None][i % 3]) for i in range(9)], "id string, kind string, `from` string, `to` string, resolution string")
    assert {r.id for r in R.filter_edges(e, kind="calls", resolution=" Compiler_Resolved ").collect()} == {"e0", "e3", "e6"}
    with pytest.raises(ValueError):
        R.filter_edges(e, resolution="guessed")
    page, n = R.keyset_page(e, "id", after="e2", size=3)
    assert [r.id for r in page.collect()] == ["e3", "e4", "e5", "e6"] and n == 3
    assert (R.page_size(0), R.page_size(999), R.clamp_limit(-1), R.clamp_limit(5000)) == (50, 200, 50, 1000)
    t = spark.sql("select * from values ('a', timestamp'2024-01-02'), ('b', timestamp'2024-01-02'), ('c', timestamp'2024-01-01'), ('d', null) t(id, at)")
    assert [r.id for r in R.time_page(t, "at", "id")[0].collect()] == ["a", "b", "c", "d"]
    assert [r.id for r in R.time_page(t, "at", "id", before=("2024-01-02", "a"))[0].collect()] == ["b", "c", "d"]


def test_cursors():
    scope = R.scope_of("nodes", "kind=a")
    c = R.encode_cursor(b"k", scope, {"id": "x"})
    assert R.decode_cursor(b"k", scope, c) == {"id": "x"} and R.scope_of("ab", "c") != R.scope_of("a", "bc")
    for key, s, text in ((b"z", scope, c), (b"k", "other", c), (b"k", scope, c[:-2] + "AA"), (b"k", scope, "junk")):
        with pytest.raises(R.CursorError):
            R.decode_cursor(key, s, text)


def test_references(spark):
    n = spark.createDataFrame([("1", "l", "q", "f"), ("2", "m", "r", "f"), ("f", None, None, None)], "id string, logical_id string, qualified_name string, name string")
    assert R.resolve_reference(n, "f") == ("found", "f") and R.resolve_reference(n, "q") == ("found", "1") and R.resolve_reference(n, "none") == ("not_found", None)
    assert R.resolve_reference(n.where("id <> 'f'"), "f") == ("ambiguous", None)


def test_coverage_of_nothing(spark):
    a = spark.createDataFrame([], "status string, text boolean, semantic boolean")
    n = spark.createDataFrame([], "id string, kind string, visibility string, public_surface boolean, evidence_ids array<string>, documentation string, confidence double, confidence_class string")
    e = spark.createDataFrame([], "resolution string")
    c = spark.createDataFrame([], "evidence_ids array<string>")
    d = spark.createDataFrame([], "status string, subject_ids array<string>")
    row = C.coverage(a, n, e, c, d, c)
    assert {v for k, v in row.first().asDict().items() if k.endswith("_ratio")} == {1.0}
    diag = spark.createDataFrame([("fatal",)], "severity string")
    assert C.quality_gates(row, diag).first().failures == ["fatal"]
    assert C.quality_gates(row, diag, digest=F.lit(""), fatal=-1).first().failures == ["digest"]


def test_merges(spark):
    rows = [("x", 1, "text", "p"), ("x", 2, "semantic_parsed", "q"), ("x", 3, "semantic_parsed", "r"), ("y", 4, None, "s")]
    df = spark.createDataFrame(rows, "id string, seq int, status string, path string")
    assert {r.id: r.path for r in M.merge_artifacts(df).collect()} == {"x": "q", "y": "s"}
    assert {r.id: r.path for r in M.merge_first(df).collect()} == {"x": "p", "y": "s"}
    assert {r.id: r.path for r in M.merge_last(df).collect()} == {"x": "r", "y": "s"}
    nodes = spark.createDataFrame(
        [("n", 1, "", "function", "f", "", "", "go", None, None, "", False, ["b"], {"k": "1"}), ("n", 2, "L", "class", "g", "q", "sig", "py", "public", "A", "h", True, ["a", "b"], {"k": "2", "j": "3"})],
        "id string, seq int, logical_id string, kind string, name string, qualified_name string, signature string, language string, visibility string, artifact_id string, semantic_hash string, public_surface boolean, evidence_ids array<string>, attributes map<string,string>",
    )
    r = M.merge_nodes(nodes).first()
    assert (r.kind, r.name, r.qualified_name, r.visibility, r.logical_id, r.signature, r.artifact_id, r.public_surface, r.evidence_ids, r.attributes) == ("function", "f", "", None, "L", "sig", "A", True, ["a", "b"], {"k": "1", "j": "3"})
    united = M.unite([df.drop("seq").withColumn("row_order", F.lit(i)) for i in range(2)])
    assert united.select("seq.stage").distinct().count() == 2
    parsed = M.mark_parsed(df, spark.createDataFrame([("x",), ("x",)], "id string"))
    assert sorted(str(r.status) for r in parsed.collect()) == ["None", "semantic_parsed", "semantic_parsed", "syntax_parsed"]


def test_name_resolution(spark):
    n = spark.createDataFrame(
        [("f", "function", "f", "p.f", ""), ("g", "method", "g", "p.C.g", ""), ("h1", "function", "h", "a.h", ""), ("h2", "function", "h", "b.h", ""), ("u1", "unresolved_symbol", "x", None, "p.f"), ("u2", "unresolved_symbol", "z.g", None, None), ("u3", "unresolved_symbol", "h", None, None), ("u4", "unresolved_symbol", "lost", None, None)],
        "id string, kind string, name string, qualified_name string, spelling string",
    )
    e = spark.createDataFrame([("1", "calls", "h1", "u1", "unresolved", 0.7), ("2", "calls", "h1", "u2", "unresolved", 0.1), ("3", "calls", "f", "u3", "unresolved", None), ("4", "calls", "f", "u1", "unresolved", None)], "id string, kind string, `from` string, `to` string, resolution string, confidence double")
    edges, nodes = M.resolve_by_name(e, n)
    got = {(r["from"], r["to"]): (r.resolution, r.confidence) for r in edges.collect()}
    assert got == {("h1", "f"): ("syntax_inferred", 0.7), ("h1", "g"): ("syntax_inferred", 0.65), ("f", "u3"): ("unresolved", None), ("f", "u1"): ("unresolved", None)}
    assert {r.id for r in nodes.collect()} == {"f", "g", "h1", "h2", "u3", "u1"}


def test_patch(spark):
    base = {"nodes": spark.createDataFrame([("a",)], "id string")}
    assert M.apply_patch(base, {"nodes": spark.createDataFrame([("b",)], "id string")})["nodes"].count() == 2
    with pytest.raises(ValueError):
        M.apply_patch(base, {"nodes": spark.createDataFrame([("a",)], "id string")})


def test_violations(spark):
    a = spark.createDataFrame([("a", "x.py", "file", "text", 1, "0" * 64), ("a", "/abs", "odd", "text", -1, "zz"), ("", "../up", "file", "odd", None, None)], "id string, path string, kind string, status string, size_bytes int, sha256 string")
    n = spark.createDataFrame([("n", "function", "f", "gone", ["e9"], 5, 4), ("m", "odd", "", None, [], 1, 1)], "id string, kind string, name string, artifact_id string, evidence_ids array<string>, start_line int, end_line int")
    e = spark.createDataFrame([("e", "calls", "n", "zz", "Resolved", 0.5, []), ("f", "odd", "n", "m", "guess", float("nan"), ["e1"])], "id string, kind string, `from` string, `to` string, resolution string, confidence double, evidence_ids array<string>")
    ev = spark.createDataFrame([("e1", "declared", 1.5)], "id string, kind string, confidence double")
    x = spark.createDataFrame([("c", "n", ["n"], "q")], "id string, subject_id string, candidate_ids array<string>, preferred_id string")
    p = spark.createDataFrame([("p", ["n", "m"], ["f"], "n", "m"), ("q", ["m", "zz"], ["f"], "n", "zz"), ("r", ["n"], ["f"], "n", "n")], "id string, node_ids array<string>, edge_ids array<string>, entry_node_id string, exit_node_id string")
    got = {(r.code, r.subject) for r in V.violations({"artifacts": a, "nodes": n, "edges": e, "evidence": ev, "conflicts": x, "paths": p}).collect()}
    assert {
        ("DUPLICATE_ARTIFACT_ID", "a"), ("EMPTY_ARTIFACT_ID", ""), ("UNSAFE_ARTIFACT_PATH", "a"), ("UNSAFE_ARTIFACT_PATH", ""), ("UNKNOWN_ARTIFACT_KIND", "a"), ("UNKNOWN_ARTIFACT_STATUS", ""), ("NEGATIVE_ARTIFACT_SIZE", "a"), ("BAD_ARTIFACT_DIGEST", "a"),
        ("UNKNOWN_NODE_KIND", "m"), ("EMPTY_NODE_NAME", "m"), ("BAD_NODE_RANGE", "n"), ("NODE_ARTIFACT_MISSING", "n"), ("NODE_EVIDENCE_MISSING", "n"), ("NODE_WITHOUT_EVIDENCE", "m"), ("UNKNOWN_EDGE_KIND", "f"), ("UNKNOWN_RESOLUTION", "f"), ("BAD_EDGE_CONFIDENCE", "f"),
        ("EDGE_TARGET_MISSING", "e"), ("EDGE_WITHOUT_EVIDENCE", "e"), ("BAD_EVIDENCE_CONFIDENCE", "e1"), ("CONFLICT_TOO_FEW_CANDIDATES", "c"), ("CONFLICT_PREFERRED_UNKNOWN", "c"), ("BAD_PATH_SHAPE", "r"), ("BAD_PATH_ENDS", "q"), ("PATH_EDGE_DISCONNECTED", "q"),
    } == got


NODE = "id string, logical_id string, language string, kind string, name string, qualified_name string, signature string, visibility string, public_surface boolean, artifact_id string, semantic_hash string, seq int"


def test_semantic_diff(spark):
    row = lambda k, sig="s", vis="public", q="q", h="h", seq=0, logical=None: (k, logical or k, "go", "function", "f", q, sig, vis, False, "a", h, seq)
    b = spark.createDataFrame([row("sig"), row("hide"), row("move", vis="private"), row("body", vis="private"), row("gone"), row("gone2", vis="private"), row("same"), row("dup", q="old", seq=1), row("dup", seq=2)], NODE)
    a = spark.createDataFrame([row("sig", sig="t"), row("hide", vis="private"), row("move", vis="private", q="r", h="h2"), row("body", vis="private", h="h2"), row("new"), row("same"), row("dup")], NODE)
    got = {r.key: (r.change_kind, r.severity, r.reasons) for r in D.diff_nodes(b, a).collect()}
    assert got == {
        "sig": ("modified", "breaking", ["public signature changed"]), "hide": ("modified", "breaking", ["public symbol became non-public"]), "move": ("modified", "risk", ["logical name changed"]), "body": ("modified", "risk", ["implementation semantics changed"]),
        "gone": ("removed", "breaking", ["public symbol removed"]), "gone2": ("removed", "info", []), "new": ("added", "info", []),
    }
    assert [r.key for r in D.ordered_nodes(D.diff_nodes(b, a)).collect()] == ["gone", "hide", "sig", "body", "move", "gone2", "new"]
    e = spark.createDataFrame([("1", "calls", "a", "b", "resolved", 1.0, "p")], "id string, kind string, `from` string, `to` string, resolution string, confidence double, producer string")
    assert D.diff_edges(e, e.withColumn("resolution", F.lit("compiler_resolved"))).collect() == []
    assert D.diff_nodes(b.limit(0), a.limit(0)).collect() == []

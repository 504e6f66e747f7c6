import pytest
from pyspark.sql import functions as F

from strataloom import api
from strataloom.operators import projections as J
from strataloom.operators.extract.registry import CAPABILITIES, Extractor, LimitError, Registry, builtin
from strataloom.sources.records import schema_of


@pytest.fixture(scope="module")
def cat(spark):
    n = spark.createDataFrame([("a", "la", "p.a", "a", ["e1", "e0"]), ("b", None, "p.b", "x", []), ("c", None, "p.c", "x", None)], "id string, logical_id string, qualified_name string, name string, evidence_ids array<string>")
    e = spark.createDataFrame([("1", "calls", "a", "b", "declared"), ("2", "references", "b", "a", "declared"), ("3", "calls", "b", "c", "declared")], "id string, kind string, `from` string, `to` string, resolution string")
    ev = spark.createDataFrame([("e0", "declared"), ("e1", "manifest")], "id string, kind string")
    return lambda surface: api.Catalogue(n, e, ev, surface=surface)


def test_surfaces(cat):
    mcp, http, cli = cat("mcp"), cat("http"), cat("cli")
    assert {r.id for r in http.neighborhood("p.a").nodes.collect()} == {"a", "b"}
    assert {r.id for r in mcp.neighborhood("p.a").nodes.collect()} == {"a", "b", "c"}
    assert {r.id for r in http.neighborhood("a", direction="sideways").nodes.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        mcp.neighborhood("a", direction="sideways")
    assert cli.path("la", "c").nodes == ["a", "b", "c"] and not cli.path("c", "a").found and http.path("c", "a").found
    with pytest.raises(api.Ambiguous):
        cli.impact("x")
    with pytest.raises(api.NotFound):
        cli.impact("nothing")
    assert [(r.component, r.size, r.cyclic) for r in http.components().collect()] == [("a", 2, True), ("c", 1, False)]
    assert {r.component for r in cli.components().collect()} == {"a", "b", "c"}
    node, ins, outs = cli.symbol("a")
    assert node.count() == 1 and [r.id for r in ins.collect()] == ["2"] and [r.id for r in outs.collect()] == ["1"]
    assert [(r.evidence_id, r.kind) for r in cli.evidence_of("a").collect()] == [("e1", "manifest"), ("e0", "declared")]


def test_projections(spark):
    a = spark.createDataFrame([("a", None, "x/y.go", "file", "go", "text", 5, "d", {}), ("b", "l", "z", "file", None, "binary", 1, None, {})], "id string, logical_id string, path string, kind string, language string, status string, size_bytes bigint, sha256 string, attributes map<string,string>")
    nodes = J.artifact_nodes(a)
    assert {(r.id, r.logical_id, r.name) for r in nodes.collect()} == {("a", "a", "y.go"), ("b", "l", "z")}
    assert {(r["from"], r["to"]) for r in J.contains_edges(a, F.lit("repo")).collect()} == {("repo", "a"), ("repo", "b")}
    assert [r.id for r in J.file_refs(a).collect()] == ["a"]
    n = spark.createDataFrame([("a", {"status": "old", "k": "v"}), ("q", None)], "id string, attributes map<string,string>")
    got = {r.id: r.attributes for r in J.refreshed_nodes(n, a).collect()}
    assert got == {"a": {"k": "v", "status": "text", "size_bytes": "5", "sha256": "d"}, "q": None}
    d = spark.createDataFrame([("d", "guide", "T", "d.md", [], "draft", None, [("s1", None, 0, "H", "*m*", None), ("s2", "s1", 1, "I", "n", "p")])], schema_of("documents"))
    assert [(r.section_id, r.text) for r in J.chunks(d).collect()] == [("s1", "*m*"), ("s2", "p")]
    c = spark.createDataFrame([("c", "x", "says", "fact", "supported", "accepted", [])], schema_of("claims"))
    full = spark.createDataFrame([], schema_of("nodes"))
    rows = J.fulltext_rows(a, full, d, c).collect()
    assert {(r.object_type, r.object_id, r.body) for r in rows} == {("artifact", "a", "file go text"), ("artifact", "b", "file binary"), ("document", "d", "guide draft"), ("document_section", "s1", "*m*"), ("document_section", "s2", "p"), ("claim", "c", "says")}
    s = spark.createDataFrame([("n", ("a", "p", 1, 2, 3, 4, 5, 6, "x")), ("m", None)], "id string, source struct<artifact_id:string,path:string,start_byte:bigint,end_byte:bigint,start_line:int,start_column:int,end_line:int,end_column:int,anchor:string>")
    assert {(r.id, r.source_path, r.start_line) for r in J.flat_source(s).collect()} == {("n", "p", 3), ("m", None, None)}
    h = spark.createDataFrame([("s", "/r", {"host": "h", "k": "v"})], "id string, root_path string, metadata map<string,string>")
    assert J.canonical_header(h).first().metadata == {"k": "v"}
    lists = spark.createDataFrame([(["b", "a"], {"z": "1", "y": "2"})], "l array<string>, m map<string,string>")
    assert list(J.canonical_lists(lists, ["l"], ["m"]).first().m.items()) == [("y", "2"), ("z", "1")] or J.canonical_lists(lists, ["l"]).first().l == ["a", "b"]
    r = spark.createDataFrame([(0, "é"), (4, "a")], "ordinal bigint, record string")
    assert tuple(J.staged_budget(r).first()) == (2, 3, 5) and tuple(J.staged_budget(r.limit(0)).first()) == (0, 0, 0)
    m = spark.createDataFrame([(2**62, 8), (3, 5)], "count bigint, size bigint")
    assert J.memory_estimate(m).first().bytes == 2**63 - 1 and J.memory_estimate(m.where("count = 3")).first().bytes == 15


def test_registry(spark):
    files = spark.createDataFrame([(1, "a.py", "def f(): pass"), (2, "b.go", "package b\nfunc G() {}\n"), (3, "c.md", "# T")], "doc_id bigint, path string, text string")
    reg = builtin()
    got = {(r.extractor, r.name) for r in reg.run("symbols", files).where("kind = 'function'").collect()}
    assert got == {("python@1", "f"), ("go@1", "G")} and reg.run("links", files) is None and "links" in CAPABILITIES
    assert [e.name for e in reg.select("manifests", "go")] == ["manifests"]
    with pytest.raises(ValueError):
        reg.add(Extractor("go", "2", "symbols", (), lambda d: d))
    with pytest.raises(ValueError):
        Registry((Extractor("x", "1", "magic", (), lambda d: d),))
    with pytest.raises(LimitError):
        Registry((Extractor("x", "1", "links", (), lambda d: d, most_rows=2),)).run("links", files)

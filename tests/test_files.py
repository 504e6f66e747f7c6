import json
import os

import pytest
from pyspark.sql import functions as F

from strataloom.operators import incremental as I
from strataloom.operators import packets as P
from strataloom.operators import redaction, windows
from strataloom.operators.extract import code, manifests, markdown, scip
from strataloom.operators.store import SnapshotStore, StoreError
from strataloom.sinks import exports as X
from strataloom.sources import records, tree
from strataloom.streaming import pipelines


def test_scan(spark, tmp_path):
    root = tmp_path / "t"
    (root / "src").mkdir(parents=True)
    (root / "vendor/x").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\ny")
    (root / "src/b.bin").write_bytes(b"\x00\x01")
    (root / "Makefile").write_text("")
    (root / "big.txt").write_text("z" * 50)
    (root / "vendor/x/c.go").write_text("package c\n")
    os.symlink("a.py", root / "src/link")
    rows = {r.path: r for r in tree.scan(spark, str(root), ["vendor"], most_text=40).collect()}
    assert {p: (r.status, r.line_count, r.language) for p, r in rows.items()} == {"src/link": ("recorded", None, ""), "src/a.py": ("text", 2, "python"), "src/b.bin": ("binary", None, ""), "Makefile": ("text", 0, "make"), "big.txt": ("oversized", None, "text"), "vendor/x/c.go": ("excluded", 1, "go")}
    listed = {(r.path, r.kind, r.size_bytes, r.target) for r in tree.listing(spark, str(root), ["vendor"]).collect()}
    assert ("src/link", "symlink", 0, "a.py") in listed and ("Makefile", "file", 0, "") in listed and not any(x[0].startswith("vendor") for x in listed)
    d = tree.scan(spark, str(root))
    dig = lambda df: tree.inventory_digest(df).first().digest
    assert dig(d) == dig(d.orderBy("path")) != dig(d.where("path <> 'Makefile'"))
    assert tree.likely_text(b"\xff\xfehello world, this is text" * 9) and not tree.likely_text(b"\xff\x01\x02")


def test_markdown(spark):
    text = "# A\n\n## B\n```\n# no\n```\nTitle\n-----\n### C `x`\n# A\n[l](../src/a.py#x) [m](http://x) [n](/b.md)\n"
    d = spark.createDataFrame([(1, "s", "docs/r.md", text), (2, "s", "x.md", None)], "doc_id bigint, snapshot_id string, path string, text string")
    got = [(r.ordinal, r.level, r.heading, r.anchor, r.parent, r.start_line, r.end_line) for r in markdown.section_table(d).orderBy("ordinal").collect()]
    assert got == [(0, 1, "A", "a", None, 1, 2), (1, 2, "B", "b", 0, 3, 6), (2, 2, "Title", "title", 0, 7, 8), (3, 3, "C x", "c-x", 2, 9, 9), (4, 1, "A", "a-2", None, 10, 11)]
    a = spark.createDataFrame([("s", "src/a.py", "A"), ("s", "b.md", "B"), ("t", "b.md", "Z")], "snapshot_id string, path string, artifact_id string")
    assert {(r.line, r.artifact_id) for r in markdown.link_table(d, a).collect()} == {(11, "A"), (11, "B")}
    assert markdown.resolve("a.md", "../../x") is None and markdown.resolve("d/a.md", "./b/../c.md?q") == "d/c.md"


def test_code():
    py = "import a.b\nfrom . import c\nclass K(Base):\n    def m(self, x=1): return y.z(x)\ndef test_it(): pass\n"
    rows = list(code.python_symbols(1, "pkg/__init__.py", py))
    assert {(r[1], r[3]) for r in rows if r[1]} == {("module", "pkg"), ("class", "pkg.K"), ("method", "pkg.K.m"), ("test", "pkg.test_it")}
    assert {(r[8], r[9]) for r in rows if r[8]} == {("imports", "a.b"), ("imports", "."), ("inherits", "Base"), ("calls", "y.z")}
    assert [r[1] for r in code.python_symbols(1, "x.py", "def (")] == ["diagnostic"]
    nested = list(code.python_symbols(1, "x.py", "def f():\n    a()\n    def g():\n        b(c())\n    return g\n"))
    assert {(r[3], r[9]) for r in nested if r[8]} == {("x.f", "a"), ("x.f.g", "b"), ("x.f.g", "c")}
    go = 'package p\n\nimport (\n\t"fmt"\n)\n\n// func no() {}\ntype T struct {}\nfunc (t *T) Run(a int) error { return nil }\nfunc helper() {}\nconst C = 1\n'
    assert {(r[1], r[3], r[5]) for r in code.go_symbols(1, "p.go", go) if r[1]} == {("package", "p", "public"), ("class", "p.T", "public"), ("method", "p.T.Run", "public"), ("function", "p.helper", "private"), ("constant", "p.C", "public")}
    assert [r[9] for r in code.go_symbols(1, "p.go", go) if r[8]] == ["fmt"]
    ts = "import x from './y';\nexport interface I {}\nexport const f = (a: number) => a;\nfunction g(b) {}\napp.get('/v1/items', h);\n// app.get('/no', h)\n"
    assert {(r[1], r[2]) for r in code.ecma_symbols(1, "m.ts", ts) if r[1]} == {("module", "m"), ("interface", "I"), ("function", "f"), ("function", "g"), ("api_endpoint", "GET /v1/items")}


def test_enclosing(spark):
    occ = spark.createDataFrame([("f", "o1", 10), ("f", "o2", 500), ("f", "o3", 1000)], "doc_id string, occurrence string, line bigint")
    defs = spark.createDataFrame([("f", "outer", 1, 600), ("f", "inner", 5, 20), ("g", "other", 1, 2000)], "doc_id string, symbol string, start_line bigint, end_line bigint")
    assert {(r.occurrence, r.symbol) for r in code.enclosing(occ, defs).collect()} == {("o1", "inner"), ("o2", "outer"), ("o3", "")}


def test_manifests():
    rows = lambda path, text: [(r[1], r[2], r[3], r[4], r[5]) for r in manifests.any_manifest(1, path, text)]
    npm = json.dumps({"name": "n", "version": "1", "dependencies": {"a": "^1"}, "scripts": {"t": "run"}, "bin": "x.js"})
    assert rows("package.json", npm) == [("project", "n", "1", None, None), ("external_dependency", "a", "^1", "depends_on", "a"), ("build_target", "t", "run", None, None), ("cli_command", "n", "x.js", None, None)]
    assert rows("package.json", '{"a": 1, "a": 2}') == [] and rows("package.json", "[") == [] and rows("x/package.json", "[]") == []
    assert rows("go.mod", "module m\n\nrequire (\n\tgithub.com/a/b v1.2.3 // x\n)\nreplace github.com/a/b => ../b\n") == [("project", "m", "", None, None), ("external_dependency", "github.com/a/b", "v1.2.3", "depends_on", "github.com/a/b"), ("external_dependency", "../b", "", "supersedes", "github.com/a/b")]
    assert rows("requirements.txt", "a==1.0\n# c\nb>=2,<3 ; x\n-r y\n") == [("external_dependency", "a", "==1.0", "depends_on", "a"), ("external_dependency", "b", ">=2,<3", "depends_on", "b")]
    assert rows("Dockerfile", "FROM a:1 AS s\nEXPOSE 80\nENV API_TOKEN=x\nARG V=1\n") == [("build_target", "s", "", "depends_on", "a:1"), ("container_image", "a:1", "", None, None), ("config_key", "port 80", "", "exposes", "s"), ("environment_variable", "API_TOKEN", "<redacted>", "configures", "s"), ("environment_variable", "V", "1", "configures", "s")]
    assert rows(".env", 'A=1\nexport DB_PASSWORD="x"\nA=2\n') == [("environment_variable", "A", "1", None, None), ("environment_variable", "DB_PASSWORD", "<redacted>", None, None)]
    schema = {"$schema": "x", "title": "T", "type": "object", "properties": {"a/b": {"$ref": "#/$defs/d"}}, "$defs": {"d": {"type": "string"}}}
    got = rows("s.json", json.dumps(schema))
    assert ("field", "a/b", "", "contains", "#/properties/a~1b") in got and (None, "#/properties/a~1b", None, "references", "#/$defs/d") in got
    api = {"openapi": "3", "info": {"title": "A", "version": "1"}, "paths": {"/x": {"get": {"operationId": "o", "parameters": [{"name": "q", "in": "query"}], "responses": {"200": {"$ref": "#/r"}}}}}, "components": {"schemas": {"S": {}}, "securitySchemes": {"k": {}}}}
    got = rows("a.json", json.dumps(api))
    assert {("api_service", "A", "1", None, None), ("api_endpoint", "GET /x", "o", "exposes", "A"), ("parameter", "q", "query", "contains", "GET /x"), ("return_value", "200", "", "contains", "GET /x"), ("schema", "S", "", "contains", "A"), ("security_scheme", "k", "", "contains", "A"), (None, None, None, "references", "#/r")} == set(got)


def test_scip():
    def field(n, v):
        return bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v

    occ = field(1, bytes([4, 2, 6])) + field(2, b"go p f().") + field(3, 1)
    sym = field(1, b"go p f().") + field(3, b"docs")
    index = field(1, b"\x00") + field(2, field(1, b"a.go") + field(4, b"go") + field(2, occ) + field(3, sym))
    assert list(scip.read_index(index)) == [("a.go", "go", "occurrence", "go p f().", 1, 5, 2, 5, 6, None), ("a.go", "go", "symbol", "go p f().", None, None, None, None, None, "docs")]
    with pytest.raises(scip.WireError):
        list(scip.read_index(index[:-3]))
    assert scip.display_name("go p T#run().") == "run" and scip.display_name("local 3") == "3"
    assert [scip.byte_offset("aé😀b", n, u) for n, u in ((3, "utf-8"), (2, "utf-16"), (4, "utf-16"), (3, "utf-32"), (99, "utf-32"))] == [3, 3, 7, 7, 8]


def test_redaction(spark):
    secret = "ghp_" + "a1" * 18
    d = spark.createDataFrame([(1, f'é\ntoken {secret}\napi_key = "abcdef123456xyz"', {"k" + secret: "v", "k<redacted>": secret}), (2, None, {}), (3, "", None)], "doc_id bigint, text string, attributes map<string,string>")
    got = {(r.kind, r.start_line, r.end_byte - r.start_byte) for r in redaction.findings(d).collect()}
    assert got == {("token", 2, 40), ("api_key", 3, 15)}
    clean = {r.doc_id: r for r in redaction.redact_record(d, [secret, "abcdef123456xyz", ""], ["text"], ["attributes"]).collect()}
    assert clean[1].text == 'é\ntoken <redacted>\napi_key = "<redacted>"' and clean[1].attributes == {"k<redacted>": "<redacted>", "k<redacted>#2": "v"}
    assert clean[2].text is None and clean[3].attributes is None


def test_windows(spark):
    h = spark.createDataFrame([(1, i, lvl, s, i * 10 + 1, 99) for i, (lvl, s) in enumerate([(1, "x"), (2, "x"), (1, ""), (3, ""), (2, "x")])], "doc_id int, ordinal int, level int, slug string, start_line int, lines int")
    assert [r.parent for r in windows.parent_headings(h).orderBy("ordinal").collect()] == [None, 0, None, 2, 2]
    assert [r.anchor for r in windows.unique_anchors(h).orderBy("ordinal").collect()] == ["x", "x-2", "section", "section-2", "x-3"]
    assert [r.end_line for r in windows.section_ends(h).orderBy("ordinal").collect()] == [10, 20, 30, 40, 99]
    j = spark.createDataFrame([("r", 1, "", "a"), ("r", 2, "a", "b"), ("r", 4, "b", "c"), ("r", 5, "x", "d"), ("q", 2, None, "z")], "run_id string, sequence bigint, previous_digest string, record_digest string")
    assert {(r.run_id, r.sequence, r.problem) for r in windows.chain_breaks(j).collect()} == {("r", 4, "gap"), ("r", 5, "broken"), ("q", 2, "gap")}
    p = spark.createDataFrame([("g", i, s) for i, s in enumerate([150, 100, 500, 10, 900, 5])] + [("h", 0, 5)], "g string, o int, size bigint")
    assert [(r.g, r.part) for r in windows.packs(p, "g", "o", 300, least=100).orderBy("g", "o").collect()] == [("g", 1), ("g", 1), ("g", 2), ("g", 3), ("g", 3), ("g", 4), ("h", 1)]
    r = spark.sql("select * from values ('a', 1L, 'run_started', timestamp'2024-01-01'), ('a', 2L, 'run_succeeded', timestamp'2024-01-02'), ('b', 1L, 'run_started', timestamp'2024-01-03') t(run_id, sequence, event, at)")
    assert [(x.run_id, x.state, x.interrupted) for x in windows.run_summaries(r).collect()] == [("b", "run_started", True), ("a", "run_succeeded", False)]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("2", "error", "A", 'm"2', "p.go", 3, 0), ("1", "note", "A", "m1", None, None, None)], "id string, severity string, code string, message string, path string, start_line int, start_column int")
    X.write_sarif(d, str(tmp_path / "s"))
    held = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "s")).collect()))
    run = held["runs"][0]
    assert run["tool"]["driver"]["rules"] == [{"id": "A", "shortDescription": {"text": "m1"}}] and [r["level"] for r in run["results"]] == ["note", "error"]
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "startColumn": 1}
    n = spark.createDataFrame([("a", "module", 'A<"&'), ("b", "package", "B"), ("c", "function", "C")], "id string, kind string, name string")
    e = spark.createDataFrame([("1", "imports", "a", "b"), ("2", "calls", "a", "c")], "id string, kind string, `from` string, `to` string")
    X.write_graphml(n, e, str(tmp_path / "g"))
    import xml.dom.minidom as dom

    assert len(dom.parseString("".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())).getElementsByTagName("edge")) == 2
    assert X.mermaid(n, e) == "flowchart LR\n  n0[\"A<'&\"]\n  n1[\"B\"]\n  n0 -->|imports| n1\n"
    pages = {r.id: r.page for r in X.symbol_pages(n.withColumn("signature", F.lit("")), e).collect()}
    assert "- imports: 1, such as `b`" in pages["a"] and "## Used by" in pages["b"]
    now = X.export_manifest(spark, str(tmp_path))
    before = spark.createDataFrame(now.collect(), now.schema)
    assert before.count() > 0 and X.manifest_differences(before, X.export_manifest(spark, str(tmp_path))).collect() == []
    (tmp_path / "new.txt").write_text("x")
    assert [r.problem for r in X.manifest_differences(before, X.export_manifest(spark, str(tmp_path))).collect()] == ["unexpected"]
    fam = {"edges": spark.createDataFrame([("1", "calls", "a", "b", "declared", 1.0, "p", ["e"], {"k": "v"})], records.schema_of("edges"))}
    X.write_families(fam, str(tmp_path / "out"))
    assert records.read_jsonl(spark, str(tmp_path / "out/edges.jsonl"), "edges").first().attributes == {"k": "v"}


def test_store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    node = lambda *ids: spark.createDataFrame([(i, "function", "f", None, 1, 1) for i in ids], "id string, kind string, name string, artifact_id string, start_line int, end_line int")
    b = s.begin(None)
    s.put(b, "nodes", node("a", "b"))
    for bad in (node("a"), node("c", "c")):
        with pytest.raises(StoreError):
            s.put(b, "nodes", bad)
    first = s.commit(b)
    assert s.current() == first and s.get(first, "nodes", "a").kind == "function" and s.get(first, "nodes", "zz") is None
    with pytest.raises(StoreError):
        s.begin(None)
    late, b2 = s.begin(first), s.begin(first)
    s.put(b2, "nodes", node("a"))
    second = s.commit(b2)
    s.put(late, "nodes", node("q"))
    with pytest.raises(StoreError) as e:
        s.commit(late)
    assert e.value.code == "conflict"
    assert [x["snapshot"] for x in s.snapshots()] == [second, first] and s.recover() == [late]
    b3 = s.begin(second)
    s.put(b3, "nodes", node("x").withColumn("kind", F.lit("odd")))
    with pytest.raises(StoreError) as e:
        s.commit(b3)
    assert e.value.code == "invalid" and s.current() == second
    s.set_current(first)
    assert s.current() == first


def test_incremental(spark):
    f = I.file_keys(spark.createDataFrame([("a", "1", 5), ("b", "2", 7), ("c", None, 1)], "path string, sha256 string, size_bytes bigint"), "x", "1")
    done = f.where("path = 'a'").select("key")
    assert {r.path for r in I.stale_files(f, done).collect()} == {"b", "c"}
    assert {(r.disposition, r.files, r.bytes) for r in I.plan(f, done).collect()} == {("restore", 1, 5), ("run", 2, 8)}
    assert I.stage_key("s", "1", ["b", "a"], "c") == I.stage_key("s", "1", ["a", "b"], "c") != I.stage_key("s", "2", ["a", "b"], "c")
    e = spark.createDataFrame([("k1", "o1", 1, 10), ("k2", "o1", 9, 10), ("k3", "o2", 1, 20), ("k4", "o9", 9, 0)], "key string, object_digest string, last_access int, size_bytes bigint")
    drop, objects = I.prune(e, 5)
    assert {r.key for r in drop.collect()} == {"k1", "k3"} and {r.object_digest for r in objects.collect()} == {"o2"}
    o = spark.createDataFrame([("o1", "o1", 10), ("o2", "bad", 20), ("o3", "o3", 5)], "object_digest string, actual_digest string, size_bytes bigint")
    r = I.inspect(e, o).first()
    assert (r.entries, r.missing, r.corrupt, r.orphans) == (4, 1, 1, 1)


def test_packets(spark):
    n = spark.createDataFrame([(f"n{i:03d}", "A" if i < 3 else None, [f"e{i}"]) for i in range(80)], "id string, artifact_id string, evidence_ids array<string>")
    e = spark.createDataFrame([(f"x{i:03d}", "calls", "n000", f"n{i:03d}", [f"e{i}"]) for i in range(1, 80)], "id string, kind string, `from` string, `to` string, evidence_ids array<string>")
    ev = n.select(F.explode("evidence_ids").alias("id")).withColumn("kind", F.lit("declared"))
    p = P.one_hop("n000", n, e, ev)
    assert p.nodes.count() == 25 and p.edges.count() == 24 and p.evidence.count() == 25
    assert {r.part: r.left_out for r in p.truncated.collect()} == {"edges": 15, "nodes": 40, "evidence": 0}
    d = spark.createDataFrame([("doc", ["n005"])], "id string, subject_ids array<string>")
    hits = spark.createDataFrame([(1, "doc"), (2, "A"), (3, "n001")], "rank int, id string")
    q = P.from_hits(hits, n, e, ev, d)
    assert {r.id for r in q.nodes.collect()} == {"n000", "n001", "n002", "n005"} and {r.id for r in q.edges.collect()} == {"x001", "x002", "x005"}
    x = spark.createDataFrame([("g", 1, "é" * 10), ("g", 2, "abc"), ("g", 3, "zz"), ("g", 4, None)], "g string, o int, t string")
    assert [r.t for r in P.excerpts(x, "g", "o", "t", 7, 9).orderBy("o").collect()] == ["ééé", "ab", ""]
    assert P.claim_problems("`f` calls it.", ["e1"], {"e1"}, {"f"}) == []
    assert P.claim_problems("A. Then `g`.", ["e2", "e2"], {"e1"}, {"f"}) == ["not_atomic", "repeated_citation", "foreign_citation:e2", "foreign_citation:e2", "unknown_identifier:g"]
    asked = []
    a = P.answer("q", lambda qs: asked.append(qs) or [1], lambda q, h: (True, ["c"] * len(asked), ["gap"] if len(asked) < 2 else [], ["more"]))
    assert a == P.Answer(True, ["c", "c"], [], 2) and asked == [["q"], ["q", "more"]]
    assert P.answer("q", lambda qs: [], None).gaps == ["insufficient_evidence"]
    u = spark.createDataFrame([(2**63 - 1, 1, 5), (7, 2, 9)], "prompt bigint, generated bigint, peak bigint")
    assert tuple(P.usage(u).first()) == (2**63 - 1, 3, 9)


def test_journal(spark, tmp_path):
    (tmp_path / "j").write_text('{"run_id": "r", "sequence": 1, "event": "run_started"}\n\n')
    r = records.read_journal(spark, str(tmp_path / "j")).first()
    assert r.sequence == 1 and len(r.digest) == 64


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one\ntwo\n")
    extract = lambda df: df.select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    run = lambda: pipelines.extract_stream(spark, str(src), extract, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "b.txt").write_text("three\n")
    run()
    assert {r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two", "three"}
    e = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:05:00"), (1, "a", 2.0, "2024-01-01 00:20:00"), (1, "b", 4.0, "2024-01-01 02:00:00")], "user_id int, event_type string, value double, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert {(r.event_type, r.n, r.total) for r in pipelines.tumbling(e).collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
    assert sorted(r.n for r in pipelines.sessions(e).collect()) == [1, 2]
    assert sum(r.n for r in pipelines.sliding(e).collect()) == 6
    e.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    q = pipelines.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbled").count() == 2

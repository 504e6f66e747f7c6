"""Queries over literal sources, whose results are stated row by row: operators that SQL can't express, against what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import projections as P
from ..operators.extract import code, manifests

_PYTHON = """import os
from . import near

class Box(Base):
    def fill(self, n=1):
        return os.path.join(n)

    def _hidden(self):
        def inner():
            deep(1)
        return inner()

def test_box():
    pass
"""
_GO = """package store

import "fmt"

const (
\tLimit = 1
\tsmall = 2
)

type Row struct {
\tName string
}

type Reader interface {
\tRead(n int) error
}

func (r *Row) Show() {
\tfmt.Println(r.Name)
}
"""
_TYPESCRIPT = """import { a } from './near';

export interface Shape { x: number }

export class Box {
  fill(n: number) { return n }
}

export const make = (n: number) => n;
function hidden() {}
"""
_DOTENV = "# comment\nexport PORT=80\nBARE\n; note\nDB_PASSWORD=pine\nPORT=81\n1BAD=2\n"


def _one(spark: SparkSession, path: str, text: str) -> DataFrame:
    return spark.createDataFrame([(1, path, text)], "doc_id bigint, path string, text string")


def _rows(df: DataFrame) -> DataFrame:
    names = ("kind", "qualified_name", "visibility", "start_line", "edge", "target")
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def python_fixture(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(code.python_table(_one(spark, "pkg/box.py", _PYTHON)))


def go_fixture(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(code.go_table(_one(spark, "store/row.go", _GO)).where("kind is not null or edge = 'calls'"))


def ecma_fixture(spark: SparkSession, folder: str) -> DataFrame:
    return code.ecma_table(_one(spark, "src/box.ts", _TYPESCRIPT)).where("kind is not null and kind <> 'module'").select("kind", "name", "visibility")


def dotenv_fixture(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.manifest_table(_one(spark, "app/.env", _DOTENV)).select("kind", "name", "value", "line")


def merge_nodes_fixture(spark: SparkSession, folder: str) -> DataFrame:
    rows = [
        ("n", 1, "", "function", "f", None, "stable", None, False, ["e2"], {"a": "1"}),
        ("n", 2, "L", "method", "g", "f()", "beta", ("x.py",), True, ["e1", "e2"], {"a": "2", "b": "3"}),
        ("m", 3, "K", "class", "", "", None, ("y.py",), None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, seq int, logical_id string, kind string, name string, signature string, stability string, source struct<path:string>, public_surface boolean, evidence_ids array<string>, attributes map<string,string>")
    out = M.merge_nodes(df)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("id", text("logical_id").alias("logical_id"), "kind", "name", text("signature").alias("signature"), text("stability").alias("stability"), text("source.path").alias("path"), "public_surface", F.array_join("evidence_ids", ",").alias("evidence"), entries.alias("attributes"))


def merge_edges_fixture(spark: SparkSession, folder: str) -> DataFrame:
    rows = [
        ("e", 1, "calls", "a", "b", "unresolved", 0.2, "p1", ["x"], {"k": "1"}),
        ("e", 2, "calls", "a", "b", "declared", 0.9, "p2", ["w"], {"k": "2", "l": "3"}),
        ("e", 3, "calls", "a", "b", "declared", 0.5, "p3", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, seq int, kind string, `from` string, `to` string, resolution string, confidence double, producer string, evidence_ids array<string>, attributes map<string,string>")
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return M.merge_edges(df).select("id", "kind", F.col("from").alias("source"), F.col("to").alias("target"), "resolution", "confidence", "producer", F.array_join("evidence_ids", ",").alias("evidence"), entries.alias("attributes"))


def chunks_fixture(spark: SparkSession, folder: str) -> DataFrame:
    rows = [("d", [("s1", "plain", "# md"), ("s2", " ", "only md"), ("s3", None, None)])]
    df = spark.createDataFrame(rows, "id string, sections array<struct<id:string,plain_text:string,markdown:string>>")
    return P.chunks(df).select("document_id", "section_id", "ordinal", "text", "sha256")


def artifact_graph_fixture(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts as nodes, and what extractors are given of them."""
    rows = [("a1", "", "file", "src/x.py", "python", "text", "d1", 3), ("a2", "L2", "file", "logo.png", "", "binary", "d2", 9)]
    df = spark.createDataFrame(rows, "id string, logical_id string, kind string, path string, language string, status string, sha256 string, size_bytes bigint")
    nodes = P.artifact_nodes(df).select("id", "logical_id", "name", "qualified_name", "artifact_id", "public_surface")
    given = P.file_refs(df).select("id", F.lit(True).alias("given"))
    return nodes.join(given, "id", "left").na.fill(False, ["given"])


QUERIES = {f.__name__: f for f in (python_fixture, go_fixture, ecma_fixture, dotenv_fixture, merge_nodes_fixture, merge_edges_fixture, chunks_fixture, artifact_graph_fixture)}

_SYMBOL = "t(kind, qualified_name, visibility, start_line, edge, target)"
ORACLE = {
    "python_fixture": f"""SELECT * FROM (VALUES
('module', 'pkg.box', 'public', '1', '', ''), ('class', 'pkg.box.Box', 'public', '4', '', ''), ('method', 'pkg.box.Box.fill', 'public', '5', '', ''), ('method', 'pkg.box.Box._hidden', 'private', '8', '', ''),
('function', 'pkg.box.Box._hidden.inner', 'public', '9', '', ''), ('test', 'pkg.box.test_box', 'public', '13', '', ''),
('', 'pkg.box', '', '1', 'imports', 'os'), ('', 'pkg.box', '', '2', 'imports', '.'), ('', 'pkg.box.Box', '', '4', 'inherits', 'Base'), ('', 'pkg.box.Box.fill', '', '6', 'calls', 'os.path.join'),
('', 'pkg.box.Box._hidden', '', '11', 'calls', 'inner'), ('', 'pkg.box.Box._hidden.inner', '', '10', 'calls', 'deep')) {_SYMBOL}""",
    "go_fixture": f"""SELECT * FROM (VALUES
('package', 'store', 'public', '1', '', ''), ('constant', 'store.Limit', 'public', '6', '', ''), ('constant', 'store.small', 'private', '7', '', ''), ('class', 'store.Row', 'public', '10', '', ''), ('field', 'store.Row.Name', 'public', '11', '', ''),
('interface', 'store.Reader', 'public', '14', '', ''), ('method', 'store.Reader.Read', 'public', '15', '', ''), ('method', 'store.Row.Show', 'public', '18', '', ''), ('', 'store.Row.Show', '', '19', 'calls', 'fmt.Println')) {_SYMBOL}""",
    "ecma_fixture": "SELECT * FROM (VALUES ('interface', 'Shape', 'public'), ('class', 'Box', 'public'), ('method', 'fill', 'public'), ('function', 'make', 'public'), ('function', 'hidden', 'private')) t(kind, name, visibility)",
    "dotenv_fixture": "SELECT * FROM (VALUES ('environment_variable', 'PORT', '80', 2::BIGINT), ('environment_variable', 'BARE', '', 3), ('environment_variable', 'DB_PASSWORD', '<redacted>', 5)) t(kind, name, value, line)",
    "merge_nodes_fixture": """SELECT * FROM (VALUES ('n', 'L', 'function', 'f', 'f()', 'stable', 'x.py', true, 'e1,e2', 'a=1,b=3'), ('m', 'K', 'class', '', '', '', 'y.py', false, '', ''))
t(id, logical_id, kind, name, signature, stability, path, public_surface, evidence, attributes)""",
    "merge_edges_fixture": "SELECT 'e' AS id, 'calls' AS kind, 'a' AS source, 'b' AS target, 'declared' AS resolution, 0.9::DOUBLE AS confidence, 'p2' AS producer, 'w,x' AS evidence, 'k=1,l=3' AS attributes",
    "chunks_fixture": "SELECT 'd' AS document_id, section_id, ordinal, text, sha256(text) AS sha256 FROM (VALUES ('s1', 0, 'plain'), ('s2', 1, 'only md'), ('s3', 2, '')) t(section_id, ordinal, text)",
    "artifact_graph_fixture": "SELECT * FROM (VALUES ('a1', 'a1', 'x.py', 'src/x.py', 'a1', false, true), ('a2', 'L2', 'logo.png', 'logo.png', 'a2', false, false)) t(id, logical_id, name, qualified_name, artifact_id, public_surface, given)",
}

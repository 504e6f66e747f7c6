"""Writing record families and reports: JSON lines, CSV, SARIF, GraphML, Mermaid, Markdown, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import is_symbol

# Kinds of an architecture diagram, and its size.
ARCHITECTURE_KINDS = ("repository", "project", "package", "module", "namespace", "api_service", "api_endpoint", "database", "queue", "build_target", "deployment")
DIAGRAM_NODES = 1000
#: The first text that opens a whole file and the last that closes it; parts between them stand in any number of files.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def write_families(families: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines for each family."""
    for name, df in families.items():
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/{name}.jsonl")


def symbol_rows(nodes: DataFrame) -> DataFrame:
    """The symbol table: 14 columns, symbol kinds only."""
    s = lambda c: F.col(f"source.{c}").alias(c)
    return nodes.where(is_symbol("kind")).select(
        "id", "logical_id", "kind", "name", "qualified_name", "signature", "language", "visibility", "public_surface", "artifact_id", s("path"), s("start_line"), s("end_line"), F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("evidence_count")
    )


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("id", "kind", "from", "to", "resolution", "confidence", "producer", F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("evidence_count"))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    rows.orderBy(*order).write.mode("overwrite").option("header", "true").option("quoteAll", "false").csv(path)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("fatal", "error"), "error").when(severity == "warning", "warning").otherwise("note")


def sarif_rules(diagnostics: DataFrame) -> DataFrame:
    """(code, message): of each code the first diagnostic by id."""
    return diagnostics.groupBy("code").agg(F.min(F.struct("id", "message")).alias("m")).select("code", F.col("m.message").alias("message"))


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """(id, result): one JSON object each; columns count from 1."""
    where = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), (F.col("start_column") + 1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("path").isNotNull(), F.array(where)).alias("locations"))
    return diagnostics.select("id", F.to_json(result).alias("result"))


def _write_wrapped(spark: SparkSession, head: str, body: DataFrame, tail: str, path: str, ordered: bool = False) -> None:
    """Lines of *body* (order, line) between a head and a tail: the first and the last file of the output, with the body's partitions between them, sorted by ranges if *ordered*."""
    if ordered:
        ends = spark.createDataFrame([(-1, "", head), (1, "", tail)], "part int, order string, value string")
        full = body.select(F.lit(0).alias("part"), F.col("order").cast("string").alias("order"), F.col("line").alias("value")).unionByName(ends)
        full.orderBy("part", "order").select("value").write.mode("overwrite").text(path)
        return
    end = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    end(head).union(body.select(F.col("line").alias("value"))).union(end(tail)).write.mode("overwrite").text(path)


def write_sarif(diagnostics: DataFrame, path: str, tool: str = "strataloom") -> None:
    """diagnostics: (id, severity, code, message, path, start_line, start_column)."""
    spark = diagnostics.sparkSession
    rules = sarif_rules(diagnostics).select(F.to_json(F.struct(F.col("code").alias("id"), F.struct(F.col("message").alias("text")).alias("shortDescription"))).alias("j"), "code")
    listed = rules.orderBy("code").agg(F.array_join(F.array_sort(F.collect_list("j")), ",").alias("r")).first().r  # as many as there are codes, a closed vocabulary
    results = sarif_results(diagnostics)
    # a comma before each but the first
    first = results.agg(F.min("id").alias("first")).scalar()
    lines = results.select(F.col("id").alias("order"), F.concat(F.when(F.col("id") == first, "").otherwise(","), "result").alias("line"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[{listed or ""}]}}}},"results":['
    _write_wrapped(spark, head, lines, "]}]}", path, ordered=True)  # the first result has no comma before it


def xml_text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit("0"), "id").alias("order"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="kind">'), xml_text(F.col("kind")), F.lit('</data><data key="name">'), xml_text(F.col("name")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.concat(F.lit("1"), "id").alias("order"), F.concat(F.lit('<edge id="'), xml_text(F.col("id")), F.lit('" source="'), xml_text(F.col("from")), F.lit('" target="'), xml_text(F.col("to")), F.lit('"><data key="kind">'), xml_text(F.col("kind")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="all" attr.name="kind" attr.type="string"/><key id="name" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">'
    _write_wrapped(nodes.sparkSession, head, graphml_lines(nodes, edges), "</graph></graphml>", path)


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    """A diagram of at most DIAGRAM_NODES architecture nodes, in order of id, and the edges among them."""
    from .. import session
    from ..operators.graph import induced

    some = session.cut(nodes.where(F.col("kind").isin(*ARCHITECTURE_KINDS)).orderBy("id").limit(DIAGRAM_NODES).select("id", "name", "kind"))
    rows = some.orderBy("id").collect()
    alias = {r.id: f"n{i}" for i, r in enumerate(rows)}
    quiet = lambda s: (s or "").replace('"', "'").replace("\n", " ")
    lines = ["flowchart LR", *[f'  {alias[r.id]}["{quiet(r.name)}"]' for r in rows]]
    # distinct ends and kinds among at most DIAGRAM_NODES nodes
    for e in induced(edges, some).select("from", "to", "kind").distinct().orderBy("from", "to", "kind").toLocalIterator():
        lines.append(f"  {alias[e['from']]} -->|{quiet(e['kind'])}| {alias[e['to']]}")
    return "\n".join(lines) + "\n"


def symbol_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, page): a Markdown page for each symbol, with what it leads to and what leads to it, by kind."""
    grouped = lambda a, b, name: edges.groupBy(F.col(a).alias("id"), "kind").agg(F.count("*").alias("n"), F.min(b).alias("one")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("- %s: %d, such as `%s`", "kind", "n", "one"))), "\n").alias(name))
    out = nodes.where(is_symbol("kind")).join(grouped("from", "to", "outs"), "id", "left").join(grouped("to", "from", "ins"), "id", "left")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n## {title}\n\n"), F.col(c))).otherwise("")
    head = F.concat(F.lit("# "), F.coalesce("name", F.lit("")), F.lit("\n\nKind: "), "kind", F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("\n\n```\n"), "signature", F.lit("\n```"))).otherwise(""))
    return out.select("id", F.concat(head, part("Leads to", "outs"), part("Used by", "ins"), F.lit("\n")).alias("page"))


def coverage_report(row: DataFrame) -> str:
    """The counts and ratios of a coverage row as a Markdown table."""
    held = row.first().asDict()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["# Coverage", "", "| Measure | Value |", "| --- | --- |", *[f"| {k} | {show(v)} |" for k, v in held.items()], ""])


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file below a folder; marker files of the commit protocol stay out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace("path", rf"^(?:file:)?/*{folder.strip('/')}/", "")
    return files.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("path").rlike(r"(^|/)[._][^/]*$"))


def manifest_differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, new or changed against a manifest."""
    b = before.select("path", F.struct("size_bytes", "sha256").alias("b"))
    n = now.select("path", F.struct("size_bytes", "sha256").alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("b") != F.col("n"), "changed")
    return b.join(n, "path", "full_outer").select("path", problem.alias("problem")).where(F.col("problem").isNotNull())

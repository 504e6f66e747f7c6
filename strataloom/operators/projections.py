"""Row-to-row projections between record families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import basename, first_filled


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    """Artifacts as graph nodes with the same id; the logical id falls back to the id."""
    none = F.lit(None).cast("string")
    return artifacts.select("id", first_filled(F.col("logical_id"), F.col("id")).alias("logical_id"), "kind", basename(F.col("path")).alias("name"), F.col("path").alias("qualified_name"), none.alias("signature"), "language", none.alias("visibility"), F.lit(False).alias("public_surface"), F.col("id").alias("artifact_id"))


def contains_edges(artifacts: DataFrame, repository: Column, prefix: str = "rec") -> DataFrame:
    """An edge from the repository to each artifact."""
    return artifacts.select(stable_id("edge", F.lit("contains"), repository, F.col("id"), prefix=prefix).alias("id"), F.lit("contains").alias("kind"), repository.alias("from"), F.col("id").alias("to"), F.lit("declared").alias("resolution"), F.lit(1.0).alias("confidence"))


def file_refs(artifacts: DataFrame) -> DataFrame:
    """What extractors are given: text files only."""
    return artifacts.where(F.col("status") == "text").select("id", "path", "language", "sha256", "size_bytes")


def refreshed_nodes(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Nodes of artifacts with the artifact's status, size and digest among their attributes."""
    fresh = artifacts.select("id", F.create_map(F.lit("status"), F.col("status"), F.lit("size_bytes"), F.col("size_bytes").cast("string"), F.lit("sha256"), F.col("sha256")).alias("_fresh"))
    kept = lambda m: F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(m), k))
    out = nodes.join(fresh, "id", "left")
    return out.withColumn("attributes", F.when(F.col("_fresh").isNotNull(), F.map_concat(kept(F.col("_fresh")), "_fresh")).otherwise(F.col("attributes"))).drop("_fresh")


def fulltext_rows(artifacts: DataFrame, nodes: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(object_type, object_id, title, qualified_name, signature, body) over five kinds of objects; a node's body is its kind, language and visibility."""
    words = lambda *c: F.concat_ws(" ", *[F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col(x)) for x in c])
    row = lambda kind, df, oid, title, qname, sig, body: df.select(F.lit(kind).alias("object_type"), F.col(oid).alias("object_id"), *[F.coalesce(x, F.lit("")).alias(n) for n, x in (("title", title), ("qualified_name", qname), ("signature", sig), ("body", body))])
    c, empty = F.col, F.lit("")
    section = documents.select("path", F.explode("sections").alias("s")).select("path", "s.*")
    parts = [
        row("artifact", artifacts, "id", basename(c("path")), c("path"), empty, words("kind", "language", "status")),
        row("node", nodes, "id", c("name"), c("qualified_name"), c("signature"), words("kind", "language", "visibility")),
        row("document", documents, "id", c("title"), c("path"), empty, words("kind", "status")),
        row("document_section", section, "id", c("heading"), c("path"), empty, first_filled(c("plain_text"), c("markdown"))),
        row("claim", claims, "id", c("category"), empty, empty, c("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunks(documents: DataFrame) -> DataFrame:
    """(document_id, section_id, ordinal, text, sha256): each section's plain text, else its markdown."""
    s = documents.select(F.col("id").alias("document_id"), F.posexplode("sections").alias("ordinal", "s"))
    text = first_filled(F.col("s.plain_text"), F.col("s.markdown"))
    return s.select("document_id", F.col("s.id").alias("section_id"), "ordinal", text.alias("text"), F.sha2(text, 256).alias("sha256"))


def flat_source(df: DataFrame) -> DataFrame:
    """The source struct as columns; null where there is none."""
    parts = ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")
    return df.select(*[c for c in df.columns if c != "source"], F.col("source.artifact_id").alias("source_artifact_id"), F.col("source.path").alias("source_path"), F.col("source.anchor").alias("source_anchor"), *[F.col(f"source.{p}").alias(p) for p in parts])


def canonical_header(snapshots: DataFrame) -> DataFrame:
    """A snapshot's header without what depends on clock or host. metadata: map."""
    gone = ("host", "pid", "duration_ms")
    return snapshots.withColumns({"created_at": F.lit(None).cast("timestamp"), "root_path": F.lit(""), "metadata": F.map_filter("metadata", lambda k, _: ~k.isin(*gone))})


def canonical_lists(df: DataFrame, lists: list[str], maps: list[str] = ()) -> DataFrame:
    """Lists sorted, maps as sorted entries, so that equal records are equal rows."""
    return df.withColumns({**{c: F.array_sort(c) for c in lists}, **{m: F.map_from_entries(F.array_sort(F.map_entries(m))) for m in maps}})


def staged_budget(records: DataFrame) -> DataFrame:
    """One row: records, bytes of their canonical text, and the next ordinal. records: (ordinal, record)."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).alias("bytes"), (F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"))


def memory_estimate(parts: DataFrame) -> DataFrame:
    """One row: the sum of count * size, held at the largest long. parts: (count, size)."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    product = F.least(F.coalesce(F.try_multiply(F.col("count").cast("decimal(19,0)"), F.col("size").cast("decimal(19,0)")), most), most)
    return parts.agg(F.coalesce(F.least(F.sum(product.cast("decimal(38,0)")), most), F.lit(0)).cast("bigint").alias("bytes"))

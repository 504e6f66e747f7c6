"""Queries of the training-data operators over a data folder, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import bare, latest, table
from ..sources.tree import detect_language
from . import fileclass, leaks, licenses, mixing, secrets, splitting, syntax


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


#: So many documents whose language isn't that of their path may be broadcast, as ids and short names.
MOST_ODD = 1_000_000


def with_language(spark: SparkSession, folder: str, columns: list[str], most_odd: int = MOST_ODD) -> DataFrame:
    """The documents' columns with ``language``, that of the valid row of their artifact ('' if none).

    Texts stay where they are read: a path mostly tells its artifact's language,
    so keys alone are joined (each is unique on both sides), and only the
    documents whose language is another one are brought to the texts, by
    broadcast up to *most_odd* of them and by a shuffle of the texts beyond.
    """
    known = table(spark, folder, "artifacts").select(bare("snapshot_id").alias("_s"), bare("artifact_id").alias("_a"), "received_at", "language").where(F.col("_s").isNotNull() & F.col("_a").isNotNull())
    known = latest(known, ["_s", "_a"], ["received_at"], ["language"])
    by_path = detect_language(F.coalesce("path", F.lit("")))
    keys = _documents(spark, folder).select(bare("snapshot_id").alias("_s"), bare("artifact_id").alias("_a"), F.col("doc_id").alias("_doc"), by_path.alias("_guess"))
    joined = keys.join(known.hint("shuffle_hash"), ["_s", "_a"], "left").select("_doc", F.coalesce("language", F.lit("")).alias("_own"), "_guess")
    odd = cut(joined.where(F.col("_own") != F.col("_guess")).select("_doc", "_own").groupBy("_doc").agg(F.max("_own").alias("_own")))
    few = odd.limit(most_odd + 1).count() <= most_odd
    docs = _documents(spark, folder).withColumn("_guess", by_path).select(*columns, F.col("doc_id").alias("_doc"), "_guess")
    return docs.join(F.broadcast(odd) if few else odd.hint("shuffle_hash"), "_doc", "left").select(*columns, F.coalesce("_own", "_guess").alias("language"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redaction_records(_documents(spark, folder)).select("doc_id", "start_line", "kind", "fingerprint")


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text after redaction, with the number of literals taken out."""
    return secrets.redacted(_documents(spark, folder))


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Literals, files and distinct secrets by kind."""
    found = secrets.redaction_records(_documents(spark, folder))
    return found.groupBy("kind").agg(F.count("*").alias("literals"), F.countDistinct("doc_id").alias("files"), F.countDistinct("fingerprint").alias("secrets"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return fileclass.classify(_documents(spark, folder))


def p2_hand_written(spark: SparkSession, folder: str) -> DataFrame:
    """The ids and paths of the files that remain."""
    docs = _documents(spark, folder).select("doc_id", "repository_id", "path")
    return docs.join(p2_found(spark, folder), "doc_id", "left_anti")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    files, trees = licenses.license_of(_documents(spark, folder), table(spark, folder, "license_catalog"))
    return files.select(F.lit("file").alias("subject_kind"), F.col("doc_id").cast("string").alias("subject_id"), "license_expression").unionByName(
        trees.select(F.lit("snapshot").alias("subject_kind"), F.col("tree").alias("subject_id"), "license_expression")
    )


def p3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Files and snapshots by license expression."""
    return p3_found(spark, folder).groupBy("subject_kind", "license_expression").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.invalid(with_language(spark, folder, ["doc_id", "text"])).select("doc_id")


def p6_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Where and how each invalid file fails."""
    return syntax.invalid(with_language(spark, folder, ["doc_id", "text"]))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, invalid files and their share by repository and language."""
    files = with_language(spark, folder, ["doc_id", "repository_id"])
    return syntax.rates(files, p6_failures(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(_documents(spark, folder), table(spark, folder, "eval_items"))


def p7_edited(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_found, with up to one word of a passage replaced, left out or put in."""
    return leaks.leaked(_documents(spark, folder), table(spark, folder, "eval_items"), max_edits=1)


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with the number of documents that hold it."""
    counts = p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, folder, "eval_items").select("item_id", "suite").join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).cast("bigint").alias("n_documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their numbers of copies."""
    return mixing.mix(_documents(spark, folder), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mix(_documents(spark, folder), table(spark, folder, "mix_targets"))[1]


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all documents over their language's limit."""
    return splitting.pieces(with_language(spark, folder, ["doc_id", "text"]), table(spark, folder, "split_limits"), lang="language")


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_kinds": p1_kinds,
    "p2_found": p2_found,
    "p2_hand_written": p2_hand_written,
    "p3_found": p3_found,
    "p3_licenses": p3_licenses,
    "p6_found": p6_found,
    "p6_failures": p6_failures,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_edited": p7_edited,
    "p7_items": p7_items,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_pieces": p9_pieces,
}

_LEAKS_SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
sized AS (SELECT item_id, w, least(12, len(w)) AS k FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS span FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM sized),
held AS (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS span FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM doc, sizes WHERE len(w) >= k)),
found AS (SELECT DISTINCT doc_id, item_id FROM held JOIN wanted USING (k, span))"""

ORACLE: dict[str, str] = {
    "p7_found": f"{_LEAKS_SQL} SELECT doc_id, item_id FROM found",
    "p7_items": f"{_LEAKS_SQL} SELECT item_id, suite, CAST(count(doc_id) AS BIGINT) AS n_documents FROM eval_items LEFT JOIN found USING (item_id) GROUP BY item_id, suite",
}

"""Merging fragments: which of several rows of one id holds, and which edges resolve.

Fragments are united in stage order and carry ``seq``, a total order of
arrival; every merge is one hash aggregation with a partial step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..vocabulary import is_symbol, resolution_rank, status_rank


def unite(fragments: list[DataFrame], order: str = "row_order") -> DataFrame:
    """Fragments in stage order with ``seq``: (place of the stage, place in the stage)."""
    numbered = [f.withColumn("seq", F.struct(F.lit(i).alias("stage"), F.col(order).cast("bigint").alias("row"))).drop(order) for i, f in enumerate(fragments)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def _first(df: DataFrame, key: list[str], best: Column | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    rank = [best.alias("_rank")] if best is not None else []
    picked = df.groupBy(*key).agg(F.min(F.struct(*rank, "seq", *[c for c in rest if c != "seq"])).alias("m"))
    return picked.select(*key, *[F.col(f"m.{c}").alias(c) for c in rest if c != "seq"])


def merge_first(df: DataFrame, key: str = "id") -> DataFrame:
    """Evidence and diagnostics: the first row of an id holds."""
    return _first(df, [key])


def merge_last(df: DataFrame, key: str = "id") -> DataFrame:
    """Documents, claims, conflicts and paths: the last row of an id holds."""
    rest = [c for c in df.columns if c not in (key, "seq")]
    return df.groupBy(key).agg(F.max(F.struct("seq", *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def merge_artifacts(df: DataFrame, key: str = "id") -> DataFrame:
    """The row with the highest status holds, the first among equals."""
    return _first(df, [key], -status_rank(F.col("status")))


def _filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))


def _union(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))


def _first_keys(c: str) -> Column:
    """Maps merged so that the first row with a key gives its value."""
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))).alias("e")))), lambda s: s["e"]))
    keep = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(keep))


def merge_nodes(df: DataFrame) -> DataFrame:
    """Evidence united; logical_id, signature, source and artifact_id from the first row that has one; public if any row is; first key wins in attributes; all else, even if empty, from the first row.

    df: (id, seq, logical_id, kind, name, qualified_name, signature, language, visibility, artifact_id, source struct, semantic_hash, public_surface boolean, evidence_ids, attributes map) and any others.
    """
    late = [c for c in ("logical_id", "signature", "source", "artifact_id") if c in df.columns]
    fixed = [c for c in df.columns if c not in ("id", "seq", "public_surface", "evidence_ids", "attributes", *late)]
    filled = lambda c: F.col(c).isNotNull() if c == "source" else _filled(c).isNotNull()
    aggs = [F.min_by(F.struct("seq", *fixed), F.col("seq")).alias("f")] + [F.min_by(F.col(c), F.when(filled(c), F.col("seq"))).alias(f"l_{c}") for c in late]
    aggs += [F.bool_or(F.coalesce("public_surface", F.lit(False))).alias("public_surface")] if "public_surface" in df.columns else []
    aggs += [_union("evidence_ids").alias("evidence_ids")] if "evidence_ids" in df.columns else []
    aggs += [_first_keys("attributes").alias("attributes")] if "attributes" in df.columns else []
    out = df.groupBy("id").agg(*aggs)
    more = [c for c in ("public_surface", "evidence_ids", "attributes") if c in df.columns]
    return out.select("id", *[F.col(f"f.{c}").alias(c) for c in fixed], *[F.col(f"l_{c}").alias(c) for c in late], *more)


def edge_ids(df: DataFrame, prefix: str = "rec") -> DataFrame:
    """Edges without an id get the stable id of kind, from and to."""
    return df.withColumn("id", F.coalesce(_filled("id"), stable_id("edge", F.col("kind"), F.col("from"), F.col("to"), prefix=prefix)))


def merge_edges(df: DataFrame) -> DataFrame:
    """Evidence united; resolution, confidence and producer from the row with the highest resolution, the first among equals; first key wins in attributes; all else from the first row."""
    best = [c for c in ("resolution", "confidence", "producer") if c in df.columns]
    fixed = [c for c in df.columns if c not in ("id", "seq", "evidence_ids", "attributes", *best)]
    aggs = [F.min_by(F.struct("seq", *fixed), F.col("seq")).alias("f"), F.min(F.struct((-resolution_rank(F.col("resolution"))).alias("r"), "seq", *best)).alias("b")]
    aggs += [_union("evidence_ids").alias("evidence_ids")] if "evidence_ids" in df.columns else []
    aggs += [_first_keys("attributes").alias("attributes")] if "attributes" in df.columns else []
    out = df.groupBy("id").agg(*aggs)
    return out.select("id", *[F.col(f"f.{c}").alias(c) for c in fixed], *[F.col(f"b.{c}").alias(c) for c in best], *[c for c in ("evidence_ids", "attributes") if c in df.columns])


def mark_parsed(artifacts: DataFrame, parsed: DataFrame) -> DataFrame:
    """``text`` becomes ``syntax_parsed`` for artifacts that an extractor parsed. parsed: (id)."""
    flags = parsed.select("id").distinct().withColumn("_parsed", F.lit(True))
    return artifacts.join(flags, "id", "left").withColumn("status", F.when(F.col("_parsed") & (F.col("status") == "text"), "syntax_parsed").otherwise(F.col("status"))).drop("_parsed")


def resolve_by_name(edges: DataFrame, nodes: DataFrame, prefix: str = "rec") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) after heuristic resolution of edges to placeholder nodes.

    An unresolved edge whose target is a placeholder (kind ``unresolved_symbol``)
    goes to the only symbol of that qualified name, else to the only symbol
    whose last name segment it is, but not to its own source.  It becomes
    syntax_inferred with a confidence of 0.65 at least and a new id; placeholders
    that no edge needs any more are dropped.  nodes: (id, kind, name,
    qualified_name, spelling).
    """
    spelled = lambda c: F.coalesce(_filled("spelling"), F.col("name")).alias(c)
    placeholders = nodes.where(F.col("kind") == "unresolved_symbol").select(F.col("id").alias("to"), spelled("wanted"))
    symbols = nodes.where(is_symbol("kind"))
    unique = lambda key: symbols.select(key.alias("wanted"), "id").where(F.coalesce("wanted", F.lit("")) != "").groupBy("wanted").agg(F.min("id").alias("hit"), F.count("*").alias("n")).where(F.col("n") == 1).drop("n")
    segment = F.regexp_extract(F.coalesce(_filled("qualified_name"), F.col("name")), r"[^./:#]*$", 0)
    open_ = edges.where(F.col("resolution") == "unresolved").join(placeholders, "to")
    found = (
        open_.join(unique(F.col("qualified_name")).withColumnRenamed("hit", "q"), "wanted", "left")
        .withColumn("last", F.regexp_extract("wanted", r"[^./:#]*$", 0))
        .join(unique(segment).withColumnsRenamed({"wanted": "last", "hit": "s"}), "last", "left")
        .withColumn("hit", F.coalesce("q", "s"))
        .where(F.col("hit").isNotNull() & (F.col("hit") != F.col("from")))
        .select("id", "hit")
    )
    moved = edges.join(found.withColumnRenamed("id", "_id"), edges["id"] == F.col("_id"), "left")
    hit = F.col("hit").isNotNull()
    out = moved.select(
        F.when(hit, stable_id("edge", F.col("kind"), F.col("from"), F.col("hit"), prefix=prefix)).otherwise(F.col("id")).alias("id"),
        "kind",
        "from",
        F.coalesce("hit", "to").alias("to"),
        F.when(hit, "syntax_inferred").otherwise(F.col("resolution")).alias("resolution"),
        F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.65))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, "unique_name_match").otherwise(F.lit(None)).alias("resolver"),
    )
    out = _first(out.withColumn("seq", F.col("resolver").isNotNull()), ["id"], -resolution_rank(F.col("resolution")))
    used = out.select(F.col("from").alias("id")).unionByName(out.select(F.col("to").alias("id"))).distinct()
    kept = nodes.where(F.col("kind") != "unresolved_symbol").unionByName(nodes.where(F.col("kind") == "unresolved_symbol").join(used, "id", "left_semi"))
    return out, kept


def logical_entities(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(logical_id, first_snapshot, last_snapshot): by time, then id. snapshots: (snapshot_id, at)."""
    seen = nodes.where(F.coalesce("logical_id", F.lit("")) != "").select("logical_id", "snapshot_id").distinct().join(snapshots, "snapshot_id")
    return seen.groupBy("logical_id").agg(F.min(F.struct("at", "snapshot_id")).alias("a"), F.max(F.struct("at", "snapshot_id")).alias("b")).select("logical_id", F.col("a.snapshot_id").alias("first_snapshot"), F.col("b.snapshot_id").alias("last_snapshot"))


def apply_patch(base: dict[str, DataFrame], patch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All families with a patch's rows added; a ValueError if an id is there already, and then nothing is added."""
    for family, rows in patch.items():
        clash = rows.select("id").join(base[family].select("id"), "id", "left_semi").take(1) or rows.groupBy("id").count().where("count > 1").take(1)
        if clash:
            raise ValueError(f"{family}: id {clash[0].id} exists already")
    return {f: df.unionByName(patch[f], allowMissingColumns=True) if f in patch else df for f, df in base.items()}

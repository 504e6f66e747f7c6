"""Ranked retrieval: field-boosted BM25, cosine, rank fusion, graph expansion.

Search documents hold (id, object_type, kind, language, title, qualified_name,
signature, path, body).  Statistics always cover all documents; filters come
before scoring, but not before counting.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined, normalized, tokenize
from ..session import cut
from ..vocabulary import is_public, is_symbol
from .graph import EdgeIndex, Options, looked_up
from .graph import _moves as moves_of
from .records import clamp_limit

# Field boosts, BM25 parameters, bonuses, fusion and decay.
BOOSTS = {"id": 3.0, "title": 8.0, "qualified_name": 7.0, "signature": 6.0, "path": 4.0, "kind": 2.0, "language": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
EXACT, PREFIX = 100.0, 12.0
BONUS_FIELDS = ("title", "qualified_name", "signature", "path", "id")
RRF_K, DECAY = 60.0, 0.55
FULLTEXT_BOOSTS = {"title": 8.0, "qualified_name": 7.0, "signature": 6.0, "body": 1.0}
HOPS_MOST, EXPAND_DEFAULT, EXPAND_MOST = 4, 200, 5000


class Query(NamedTuple):
    text: str = ""
    kinds: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    path: str = ""
    limit: int = 0


_INLINE = re.compile(r"^(kind|lang|language|type|path):(.+)$", re.I)


def parse_query(query: Query) -> Query:
    """Inline filters (``kind: lang: language: type: path:``) taken out of the text; filters given explicitly win."""
    text, kinds, languages, types, path = [], [], [], [], ""
    for word in query.text.split():
        m = _INLINE.match(word)
        if not m:
            text.append(word)
            continue
        name, value = m.group(1).lower(), m.group(2)
        if name == "kind":
            kinds.append(value)
        elif name in ("lang", "language"):
            languages.append(value)
        elif name == "type":
            types.append(value)
        else:
            path = value
    return Query(" ".join(text), query.kinds or tuple(kinds), query.languages or tuple(languages), query.types or tuple(types), query.path or path, query.limit)


def matches(query: Query) -> Column:
    out = F.lit(True)
    for col, values in (("kind", query.kinds), ("language", query.languages), ("object_type", query.types)):
        out = out & F.col(col).isin(*values) if values else out
    return out & F.col("path").startswith(query.path) if query.path else out


def terms_of(text: str) -> list[str]:
    """The tokens of a query, each once, as ``tokenize`` has them."""
    from .text_rules import tokens

    return list(dict.fromkeys(tokens(text)))


# --- Search documents ----------------------------------------------------------


def node_documents(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """nodes: with attributes map and source_path; artifacts: (artifact_id, path). Body from docstring, summary, description, purpose."""
    attr = lambda k: F.col("attributes")[k]
    paths = artifacts.select("artifact_id", F.col("path").alias("_path")).distinct()
    out = nodes.join(paths, "artifact_id", "left")
    return out.select("id", F.lit("node").alias("object_type"), "kind", "language", F.col("name").alias("title"), "qualified_name", "signature", F.coalesce(F.when(F.coalesce("source_path", F.lit("")) != "", F.col("source_path")), "_path", F.lit("")).alias("path"), joined(*map(attr, ("docstring", "summary", "description", "purpose"))).alias("body"))


def artifact_documents(artifacts: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return artifacts.select("id", F.lit("artifact").alias("object_type"), "kind", "language", F.regexp_extract("path", r"[^/]*$", 0).alias("title"), F.col("path").alias("qualified_name"), F.lit("").alias("signature"), "path", F.concat_ws(" ", text(F.col("media_type")), text(F.col("status"))).alias("body"))


def section_documents(documents: DataFrame) -> DataFrame:
    """documents: with sections array<struct<heading, plain_text>>."""
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.coalesce(s["heading"], F.lit("")), F.lit("\n"), F.coalesce(s["plain_text"], F.lit("")), F.lit("\n"))), "")
    return documents.select("id", F.lit("document").alias("object_type"), "kind", F.lit("").alias("language"), "title", F.col("path").alias("qualified_name"), F.lit("").alias("signature"), "path", body.alias("body"))


def embedding_text(most_bytes: int) -> Column:
    """Labelled lines of a search document, cut to a number of bytes at a character border."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    whole = F.concat_ws("\n", *[line(x, F.col(x)) for x in ("object_type", "kind", "language", "title", "qualified_name", "signature", "path", "body")])
    raw = F.encode(whole, "UTF-8")
    # a cut within a character leaves up to three bytes that don't decode
    tries = [F.decode(F.substring(raw, 1, most_bytes - k), "UTF-8") for k in range(4)]
    fits = F.octet_length(whole) <= most_bytes
    return F.when(fits, whole).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, 1, most_bytes - k)), t) for k, t in enumerate(tries)]))


# --- Lexical -------------------------------------------------------------------


def _tagged(docs: DataFrame, boosts: dict[str, float]) -> Column:
    """All (field, term) pairs of a document."""

    def tag(f: str) -> Column:
        return F.transform(tokenize(F.col(f)), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))

    return F.flatten(F.array(*map(tag, boosts)))


def _boost(field: Column, boosts: dict[str, float]) -> Column:
    return reduce(lambda w, kv: w.when(field == kv[0], kv[1]), list(boosts.items())[1:], F.when(field == next(iter(boosts)), next(iter(boosts.values()))))


def postings(docs: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(term, doc_id, tf, boost, fields): counts over all fields, the greatest boost, the fields sorted."""
    exploded = docs.select(F.col("id").alias("doc_id"), F.explode(_tagged(docs, boosts)).alias("x"))
    return exploded.groupBy(F.col("x.term").alias("term"), "doc_id").agg(F.count("*").alias("tf"), F.max(_boost(F.col("x.field"), boosts)).alias("boost"), F.array_sort(F.collect_set("x.field")).alias("fields"))


def index_stats(docs: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """One row: documents, tokens and the average length."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(_tagged(docs, boosts))), F.lit(0)).alias("tokens")).withColumn("average", F.when(F.col("tokens") > 0, F.col("tokens") / F.col("documents")).otherwise(F.lit(1.0)))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def rounded(c: Column) -> Column:
    return F.round(c * 1_000_000) / 1_000_000


def lexical_scores(docs: DataFrame, query: Query, boosts: dict[str, float] = BOOSTS, bonuses: bool = True) -> DataFrame:
    """(id, score, reasons, terms) of every document that holds a query term, not rounded.

    One pass tokenises the documents; only the query's terms are exploded and
    shuffled.  The statistics are one row and as many rows as the query has terms.
    """
    terms = terms_of(query.text)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("reasons"), F.array().cast("array<string>").alias("terms")).limit(0)
    tagged = docs.withColumn("_tags", _tagged(docs, boosts))
    light = tagged.select("id", *[c for c in docs.columns if c not in ("id", "body")], F.size("_tags").alias("_length"), F.filter("_tags", lambda x: x["term"].isin(*terms)).alias("_hits"))
    light = cut(light)
    stats = light.agg(F.count("*").alias("_n"), F.avg("_length").alias("_avg"))
    per = light.where(F.size("_hits") > 0).select("id", "_length", matches(query).alias("_ok"), F.explode("_hits").alias("x")).groupBy("id", F.col("x.term").alias("term")).agg(
        F.first("_length").alias("_length"), F.first("_ok").alias("_ok"), F.count("*").alias("tf"), F.max(_boost(F.col("x.field"), boosts)).alias("boost"), F.array_sort(F.collect_set("x.field")).alias("fields")
    )
    df = per.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as terms
    count, mean = stats.select("_n").scalar(), stats.select("_avg").scalar()
    n, d, avg, tf = count, F.col("df"), F.when(mean > 0, mean).otherwise(1.0), F.col("tf")
    idf = F.ln(1 + (n - d + 0.5) / (d + 0.5))
    bm25 = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_length") / avg)) * F.col("boost")
    scored = per.where("_ok").join(F.broadcast(df), "term").select("id", "term", bm25.alias("s"), F.transform("fields", lambda f: F.concat(f, F.lit(":"), F.col("term"))).alias("r"))
    sums = scored.groupBy("id").agg(F.sum("s").alias("score"), F.flatten(F.collect_list("r")).alias("reasons"), F.array_sort(F.collect_set("term")).alias("terms"))
    if not bonuses:
        return sums.select("id", "score", F.array_sort("reasons").alias("reasons"), "terms")
    said = " ".join(_all_terms(query.text))
    plus, why = F.lit(0.0), []
    for f in BONUS_FIELDS:
        value = normalized(F.col(f))
        exact, prefix = value == said, value.startswith(said)
        plus = plus + F.when(exact, EXACT).when(prefix, PREFIX).otherwise(0.0)
        why.append(F.when(exact, f"exact_{f}").when(prefix, f"prefix_{f}"))
    extra = light.where(F.size("_hits") > 0).select("id", plus.alias("_plus"), F.array_compact(F.array(*why)).alias("_why"))
    return sums.join(extra, "id").select("id", (F.col("score") + F.col("_plus")).alias("score"), F.array_sort(F.concat("reasons", "_why")).alias("reasons"), "terms")


def _all_terms(text: str) -> list[str]:
    from .text_rules import tokens

    return tokens(text)


def lexical_search(docs: DataFrame, query: Query) -> DataFrame:
    """(id, score, reasons, terms), best first by score, then qualified name and id; one row beyond the limit tells that there are more."""
    q = parse_query(query)
    hits = lexical_scores(docs, q).withColumn("score", rounded(F.col("score")))
    named = hits.join(docs.select("id", F.coalesce("qualified_name", F.lit("")).alias("_q")), "id")
    return named.orderBy(F.desc("score"), F.concat("_q", F.lit("\x00"), "id")).limit(clamp_limit(q.limit) + 1).drop("_q")


def fulltext_search(docs: DataFrame, query: Query) -> DataFrame:
    """The variant with any-term semantics over title, name, signature and body, without bonuses or inline filters; order by score, type, id."""
    hits = lexical_scores(docs, query, FULLTEXT_BOOSTS, bonuses=False).withColumn("score", rounded(F.col("score")))
    typed = hits.join(docs.select("id", "object_type"), "id")
    return typed.orderBy(F.desc("score"), "object_type", "id").limit(4 * clamp_limit(query.limit) + 1)


# --- Dense ---------------------------------------------------------------------


def normalized_vector(v: Column) -> Column:
    """The vector in unit length; null for empty, zero and non-finite ones."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    fine = (F.size(v) > 0) & (size > 0) & ~F.isnan(size) & (size < float("inf"))
    return F.when(fine, F.transform(v, lambda x: (x / size).cast("float")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_norm_violations(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Vectors whose length isn't 1. vectors: (id, embedding)."""
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.where(~(F.abs(size - 1) <= tolerance)).select("id", size.alias("norm"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine for each query; ties by id.

    The query set is taken in blocks of *block* vectors; every block is one
    pass over all vectors with a matrix product per batch, which leaves k
    candidates per query and batch.  Vectors of another length than the query,
    zero and null ones are left out.
    """
    held = queries.select("query_id", normalized_vector(F.col("embedding")).alias("e")).where(F.col("e").isNotNull()).orderBy("query_id")
    rows = held.toLocalIterator()
    parts: list[DataFrame] = []
    batch: list = []

    def one(some: list) -> DataFrame:
        ids = [r.query_id for r in some]
        matrix = np.array([r.e for r in some], dtype=np.float64)

        def near(batches):
            for pdf in batches:
                pdf = pdf[[len(v) == matrix.shape[1] for v in pdf["e"]]]
                if not len(pdf):
                    continue
                scores = np.stack(pdf["e"].to_numpy()).astype(np.float64) @ matrix.T
                keys = pdf["id"].to_numpy()
                for j, q in enumerate(ids):
                    s = np.round(scores[:, j] * 1e6) / 1e6
                    top = np.lexsort((keys, -s))[:k]
                    yield pd.DataFrame({"query_id": q, "id": keys[top], "score": s[top]})

        kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "id"))}
        unit = vectors.select("id", normalized_vector(F.col("embedding")).alias("e")).where(F.col("e").isNotNull())
        return unit.mapInPandas(near, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    for r in rows:
        batch.append(r)
        if len(batch) == block:
            parts.append(one(batch))
            batch = []
    if batch or not parts:
        parts.append(one(batch) if batch else vectors.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0))
    near = reduce(lambda a, b: a.unionByName(b), parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- Fusion --------------------------------------------------------------------


def channel_ranks(hits: DataFrame, order: list[Column], channel: str) -> DataFrame:
    """A channel's hits (a bounded top list) with their ranks from 1."""
    return hits.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(channel).alias("channel"))


def fuse(channels: list[DataFrame], limit: int, keep_reasons: bool = False) -> DataFrame:
    """Reciprocal rank fusion of channels (id, rank, channel[, reasons]); reasons name channel and rank."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels).where(F.coalesce(F.trim("id"), F.lit("")) != "")
    mark = F.concat("channel", F.lit("_rank:"), F.col("rank").cast("string"))
    score = F.sum(1.0 / (RRF_K + F.col("rank")))
    why = F.array_sort(F.collect_set(mark))
    if keep_reasons:
        why = F.array_sort(F.array_distinct(F.concat(why, F.flatten(F.collect_list(F.coalesce("reasons", F.array().cast("array<string>")))))))
    out = rows.groupBy("id").agg((score if keep_reasons else rounded(score)).alias("score"), why.alias("reasons"))
    return out.orderBy(F.desc("score"), "id").limit(clamp_limit(limit))


def merge_responses(responses: list[DataFrame], limit: int) -> DataFrame:
    """Hits (id, rank, reasons) of several phrasings of a question, fused without rounding; reasons are kept and ``verification_query:<i>`` added."""
    marked = [r.select("id", "rank", F.lit(f"query{i}").alias("channel"), F.array_append("reasons", F.lit(f"verification_query:{i}")).alias("reasons")) for i, r in enumerate(responses)]
    rows = reduce(lambda a, b: a.unionByName(b), marked).where(F.coalesce(F.trim("id"), F.lit("")) != "")
    out = rows.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return out.orderBy(F.desc("score"), "id").limit(clamp_limit(limit))


def repair_queries(queries: list[str], most: int = 3) -> list[str]:
    """Follow-up queries in one line each, without filter marks, of 512 bytes at most, distinct without case."""
    out: list[str] = []
    for q in queries:
        clean = "".join(" " if c in ":\\" or ord(c) < 32 else c for c in q if not 0xD800 <= ord(c) < 0xE000)
        clean = " ".join(clean.split()).encode()[:512].decode("utf-8", "ignore").strip()
        if clean and clean.lower() not in {x.lower() for x in out}:
            out.append(clean)
    return out[:most]


def synthesis_subjects(nodes: DataFrame, limit: int) -> DataFrame:
    """Public symbols with evidence, by qualified name (else name) and id."""
    fit = is_symbol("kind") & is_public(F.col("public_surface"), F.col("visibility")) & (F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0)
    fit = fit & ~F.col("kind").isin("unresolved_symbol", "secret", "repository", "directory")
    name = F.coalesce(F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")), "name")
    return nodes.where(fit).orderBy(name, "id").limit(limit)


# --- Graph expansion -----------------------------------------------------------


class Response(NamedTuple):
    hits: DataFrame  # (id, score, reasons), best first
    mode: str
    truncated: bool


def expand(hits: DataFrame, edges: DataFrame | EdgeIndex, documents: DataFrame, hops: int, limit: int, budget: int = 0, accept: Column | None = None, mode: str = "lexical", truncated: bool = False) -> Response:
    """Hits (id, score, is_node[, reasons]) with bonuses for graph neighbours: score * 0.55^depth from each hit that is a node.

    Each seed may reach as many nodes as its predecessors in hit order have left
    of the budget; a seed's reach is counted in breadth-first order of discovery.
    All seeds walk at once, level by level, and no level keeps more nodes of a
    seed than the budget; the budget is then shared out by the sizes of the
    reaches, which equals taking the seeds one by one.  Hits are a bounded list.
    """
    hops = min(max(hops, 0), HOPS_MOST)
    budget = EXPAND_DEFAULT if budget <= 0 else min(budget, EXPAND_MOST)
    own = F.coalesce("reasons", F.array().cast("array<string>")) if "reasons" in hits.columns else F.array().cast("array<string>")
    ranked = cut(hits.select("id", "score", "is_node", own.alias("own"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("_order")))
    seeds = ranked.where("is_node").select(F.col("id").alias("seed"), "_order", F.col("score").alias("seed_score"))
    moves = moves_of(edges, Options()).select("at", "next").distinct() if not isinstance(edges, EdgeIndex) else moves_of(edges, Options())
    frontier = cut(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(1).alias("rank")))
    reached = frontier
    found_first = Window.partitionBy("seed").orderBy("prank", "id")
    for depth in range(1, hops + 1):
        n = frontier.count()
        if not n:
            break
        met = looked_up(moves, frontier.select("seed", F.col("id").alias("at"), F.col("rank").alias("prank")), n)
        step = met.groupBy("seed", F.col("next").alias("id")).agg(F.min("prank").alias("prank")).join(reached, ["seed", "id"], "left_anti")
        first = step.withColumn("rank", F.row_number().over(found_first)).where(F.col("rank") <= budget)
        frontier = cut(first.select("seed", "id", F.lit(depth).alias("depth"), "rank"))
        reached = reached.unionByName(frontier)
    # what each seed may keep, and what its predecessors left of the budget; as many rows as hits
    sizes = reached.groupBy("seed").agg(F.count("*").alias("n"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("_order"))
    rooms = cut(ranked.join(sizes, (F.col("id") == F.col("seed")) & F.col("is_node"), "left").select("_order", "is_node", F.col("id").alias("seed"), F.coalesce("n", F.lit(0)).alias("n"), (F.lit(budget) - upto + F.coalesce("n", F.lit(0))).alias("room")))
    cut_off = bool(rooms.where((F.col("room") <= 0) | (F.col("n") > F.col("room"))).take(1))
    order = Window.partitionBy("seed").orderBy("depth", "rank")
    kept = reached.join(F.broadcast(rooms.where("is_node").select("seed", "room")), "seed").withColumn("_used", F.row_number().over(order)).where(F.col("_used") <= F.col("room"))
    mark = F.format_string("graph_from:%s:depth:%d", "seed", "depth")
    bonus = kept.where(F.col("depth") >= 1).join(seeds, "seed").select("id", (F.col("seed_score") * F.pow(F.lit(DECAY), F.col("depth"))).alias("bonus"), mark.alias("reason"))
    allowed = documents.where(accept) if accept is not None else documents
    gained = bonus.join(allowed.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("bonus").alias("bonus"), F.collect_set("reason").alias("graph_reasons"))
    full = ranked.select("id", "score", "own").join(gained, "id", "full_outer")
    total = rounded(F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)))
    none = F.array().cast("array<string>")
    why = F.array_sort(F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("graph_reasons", none))))
    out = full.select("id", total.alias("score"), why.alias("reasons")).orderBy(F.desc("score"), "id")
    most = clamp_limit(limit)
    return Response(out.limit(most), f"{mode}+graph", truncated or cut_off or len(out.limit(most + 1).select("id").collect()) > most)

"""Search over stored indexes: postings, document fields and vectors written once, and one entry for all modes.

A lexical index holds one row per (term, document), sorted by term, so that a
query's pushed-down list of terms reads the parts of the files with those terms
only; the documents' fields without their bodies; and one row of statistics.
A vector index holds vectors of unit length.  Both carry a version and refuse
to be loaded under another.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from . import retrieval as R
from .graph import EdgeIndex
from .records import LIMIT_MOST, clamp_limit

#: Versions of the stored forms.
LEXICAL_VERSION, VECTOR_VERSION = "strataloom-lexical-1", "strataloom-vector-1"
#: How many times the limit is fetched as candidates; modes.
OVER_FETCH, MODES = 4, ("lexical", "semantic", "hybrid")
_FIELDS = ("id", "object_type", "kind", "language", "title", "qualified_name", "signature", "path")


class VersionMismatch(ValueError):
    pass


def _stats(spark: SparkSession, folder: str, version: str):
    row = spark.read.parquet(f"{folder}/stats").first()
    if row is None or row.version != version:
        raise VersionMismatch(f"{folder}: {row.version if row else 'no index'}, not {version}")
    return row


class LexicalIndex(NamedTuple):
    documents: DataFrame  # the fields, and those that bonuses compare in their normal form
    postings: DataFrame  # (term, id, tf, boost, fields, length)
    n_documents: int
    n_tokens: int
    average: float
    bonuses: bool

    @staticmethod
    def build(docs: DataFrame, folder: str, boosts: dict[str, float] = R.BOOSTS, bonuses: bool = True, partitions: int = 16) -> LexicalIndex:
        """Write the index of search documents, whose ids are unique, replacing what is there.

        Null fields count as empty.  The texts are tokenised once, and only
        terms and counts are shuffled.
        """
        spark = docs.sparkSession
        tagged = docs.select("id", R._tagged(docs, boosts).alias("tags"))
        each = tagged.select("id", F.size("tags").alias("length"), F.explode("tags").alias("x"))
        per = each.groupBy(F.col("x.term").alias("term"), "id").agg(
            F.count("*").alias("tf"), F.max(R._boost(F.col("x.field"), boosts)).alias("boost"), F.array_sort(F.collect_set("x.field")).alias("fields"), F.first("length").cast("bigint").alias("length")
        )
        # by term and document, so that a term of very many documents fills several files
        per.repartitionByRange(partitions, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _FIELDS]
        plain = [normalized(F.col(f)).alias(f"n_{f}") for f in R.BONUS_FIELDS]
        docs.select(*fields, *plain).write.mode("overwrite").parquet(f"{folder}/documents")
        stored = spark.read.parquet(f"{folder}/postings")
        n, tokens = docs.count(), stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).first().t
        spark.createDataFrame([(LEXICAL_VERSION, n, int(tokens), bonuses)], "version string, n_documents bigint, n_tokens bigint, bonuses boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        return LexicalIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LexicalIndex:
        s = _stats(spark, folder, LEXICAL_VERSION)
        average = s.n_tokens / s.n_documents if s.n_tokens else 1.0
        return LexicalIndex(spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/postings"), s.n_documents, s.n_tokens, average, s.bonuses)

    def terms(self) -> DataFrame:
        """(term, df, tf, boost) of every term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("boost").alias("boost"))

    def _hits(self, query: R.Query) -> DataFrame:
        """The documents' fields with score, reasons and terms, of all that hold a term and pass the filters."""
        terms = R.terms_of(query.text)
        if not terms:
            none = F.array().cast("array<string>")
            return self.documents.withColumns({"score": F.lit(0.0), "reasons": none, "terms": none}).limit(0)
        per = self.postings.where(F.col("term").isin(terms))
        df = per.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
        d, tf, k, b = F.col("df"), F.col("tf"), R.K1, R.B
        bm25 = F.ln(1 + (self.n_documents - d + 0.5) / (d + 0.5)) * (tf * (k + 1)) / (tf + k * (1 - b + b * F.col("length") / self.average)) * F.col("boost")
        scored = per.join(F.broadcast(df), "term").select("id", "term", bm25.alias("s"), F.transform("fields", lambda f: F.concat(f, F.lit(":"), F.col("term"))).alias("r"))
        sums = scored.groupBy("id").agg(F.sum("s").alias("score"), F.flatten(F.collect_list("r")).alias("reasons"), F.array_sort(F.collect_set("term")).alias("terms"))
        met = self.documents.where(R.matches(query)).join(sums, "id")
        score, why = F.col("score"), F.col("reasons")
        if self.bonuses:
            said, extra = " ".join(R._all_terms(query.text)), []
            for f in R.BONUS_FIELDS:
                exact, prefix = F.col(f"n_{f}") == said, F.col(f"n_{f}").startswith(said)
                score = score + F.when(exact, R.EXACT).when(prefix, R.PREFIX).otherwise(0.0)
                extra.append(F.when(exact, f"exact_{f}").when(prefix, f"prefix_{f}"))
            why = F.concat(why, F.array_compact(F.array(*extra)))
        return met.withColumns({"score": R.rounded(score), "reasons": F.array_sort(why)})

    def search(self, query: R.Query) -> DataFrame:
        """(id, object_type, score, reasons, terms) as ``lexical_search``: best first, one row beyond the limit."""
        q = R.parse_query(query)
        return self._hits(q).orderBy(F.desc("score"), F.concat("qualified_name", F.lit("\x00"), "id")).limit(clamp_limit(q.limit) + 1).select("id", "object_type", "score", "reasons", "terms")

    def fulltext(self, query: R.Query) -> DataFrame:
        """As ``fulltext_search``: no inline filters, order by score, type and id."""
        return self._hits(query).orderBy(F.desc("score"), "object_type", "id").limit(4 * clamp_limit(query.limit) + 1).select("id", "object_type", "score", "reasons", "terms")


class BadVector(ValueError):
    pass


class VectorIndex(NamedTuple):
    vectors: DataFrame  # (id, embedding) in unit length
    dimensions: int

    @staticmethod
    def build(vectors: DataFrame, folder: str, partitions: int = 16) -> VectorIndex:
        """Write the vectors (id, embedding) in unit length.

        Null ids are left out.  An empty, zero or non-finite vector, and
        vectors of different lengths, are errors; no vectors at all are none.
        """
        spark = vectors.sparkSession
        held = vectors.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), R.normalized_vector(F.col("embedding")).alias("embedding"))
        held.repartition(partitions, "id").write.mode("overwrite").parquet(f"{folder}/vectors")
        s = spark.read.parquet(f"{folder}/vectors").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("bad")).first()
        if s.bad or s.low != s.high:
            raise BadVector(f"{s.bad} vectors without direction, dimensions from {s.low} to {s.high}")
        spark.createDataFrame([(VECTOR_VERSION, s.low or 0)], "version string, dimensions int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        return VectorIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, check: bool = False) -> VectorIndex:
        """*check*: whether every vector is verified to be of unit length."""
        s = _stats(spark, folder, VECTOR_VERSION)
        vectors = spark.read.parquet(f"{folder}/vectors")
        if check and (bad := R.unit_norm_violations(vectors).select("id").first()):
            raise BadVector(f"vector {bad.id} isn't of unit length")
        return VectorIndex(vectors, s.dimensions)

    def search(self, documents: DataFrame, query: R.Query, vector: list[float]) -> DataFrame:
        """(id, object_type, score, reasons) of the nearest documents that pass the filters, one beyond the limit; ties by id."""
        v = np.array(vector, dtype=np.float32)
        size = float(np.sqrt((v.astype(np.float64) ** 2).sum())) if v.size else 0.0
        if v.size != self.dimensions or not np.isfinite(size) or size == 0:
            raise BadVector(f"a query vector of {v.size} dimensions and length {size}; the index has {self.dimensions} dimensions")
        unit = F.array(*[F.lit(float(np.float32(x / size))) for x in v.astype(np.float64)])
        q = R.parse_query(query)
        score = R.rounded(R.dot(F.col("embedding"), unit))
        near = self.vectors.select("id", score.alias("score")).where(~F.isnan("score"))
        met = near.join(documents.where(R.matches(q)).select("id", "object_type"), "id")
        return met.orderBy(F.desc("score"), "id").limit(clamp_limit(q.limit) + 1).select("id", "object_type", "score", F.array(F.lit("dense_cosine")).alias("reasons"))


class Engine:
    """Lexical, semantic and hybrid search with graph expansion.

    *embed* gives the vector of a query's text; *edges* is what graph
    expansion walks over, from hits of the object type ``node``.
    """

    def __init__(self, lexical: LexicalIndex, vectors: VectorIndex | None = None, embed: Callable[[str], list[float]] | None = None, edges: DataFrame | EdgeIndex | None = None):
        self.lexical, self.vectors, self.embed, self.edges = lexical, vectors, embed, edges

    def search(self, query: R.Query, mode: str = "hybrid", hops: int = 0, nodes: int = 0) -> R.Response:
        """Hits (id, score, reasons) with the mode that found them and whether there are more.

        Four times the limit are fetched as candidates, 1 000 at most.  Hybrid
        search fuses both channels by their ranks.
        """
        if mode not in MODES:
            raise ValueError(f"retrieval mode {mode!r}")
        limit = clamp_limit(query.limit)
        most = min(OVER_FETCH * limit, LIMIT_MOST)
        wide = query._replace(limit=most)
        if mode != "lexical" and (self.vectors is None or self.embed is None):
            raise ValueError("semantic search needs a vector index and an embedding")
        channels, name = [], "lexical"
        if mode != "semantic":
            by_name = F.concat("qualified_name", F.lit("\x00"), "id")
            channels.append(("lexical", self.lexical._hits(R.parse_query(wide)).orderBy(F.desc("score"), by_name).limit(most + 1).select("id", "object_type", "score", "reasons", F.row_number().over(Window.orderBy(F.desc("score"), by_name)).alias("rank"))))
        if mode != "lexical":
            near = self.vectors.search(self.lexical.documents, wide, self.embed(query.text))
            channels.append(("semantic", near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))))
            name = "semantic"
        more = F.lit(False)
        if len(channels) == 1:
            hits = channels[0][1].where(F.col("rank") <= most).select("id", "object_type", "score", "reasons")
            more = channels[0][1].agg((F.count("*") > most).alias("m"))
        else:
            name = "hybrid-rrf"
            rows = channels[0][1].select("id", "object_type", "rank", F.lit("lexical").alias("channel")).unionByName(channels[1][1].select("id", "object_type", "rank", F.lit("semantic").alias("channel"))).where(F.col("rank") <= most)
            mark = F.concat("channel", F.lit("_rank:"), F.col("rank").cast("string"))
            fused = rows.groupBy("id").agg(F.first("object_type").alias("object_type"), R.rounded(F.sum(1.0 / (R.RRF_K + F.col("rank")))).alias("score"), F.array_sort(F.collect_set(mark)).alias("reasons"))
            hits = fused.orderBy(F.desc("score"), "id").limit(most)
            more = fused.agg((F.count("*") > most).alias("m"))
        truncated = bool(more.first().m)
        if hops > 0 and self.edges is not None:
            marked = hits.select("id", "score", (F.col("object_type") == "node").alias("is_node"), "reasons")
            wider = R.expand(marked, self.edges, self.lexical.documents, hops, LIMIT_MOST, nodes, R.matches(R.parse_query(query)), name, truncated)
            hits, name, truncated = wider
        kept = hits.orderBy(F.desc("score"), "id") if hops > 0 or len(channels) > 1 or mode == "semantic" else hits
        count = len(kept.limit(limit + 1).select("id").collect())
        return R.Response(kept.limit(limit).select("id", "score", "reasons"), name, truncated or count > limit)

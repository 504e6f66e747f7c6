"""One set out of several sources, each with its target share of all tokens.

Hash-threshold histograms: every document has a fixed hash, and a source's
extra copies go to the documents below a threshold.  The threshold is found
from sums of tokens by source and hash bucket; only the bucket on the border
is split into finer ones, until it holds one document.  No sort, no shuffle
of documents: the copies follow from a comparison with the threshold.  Where a
long document on the border leaves a source off its budget by far, a further
threshold is found the same way behind it, for documents no longer than what is
missing, and so on until the budget is met.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import bare
from . import tokens
from ._texts import per_row

#: A table of more targets isn't taken as one.
MOST_SOURCES = 10_000
#: A source may be off its budget by this share before a further threshold is sought, and so many are at most.
TOLERANCE, LEVELS = 0.001, 8
#: Bits of the hash that one histogram looks at, and the number of such steps.
BUCKET_BITS, STEPS = 10, 6
_HASH_BITS = BUCKET_BITS * STEPS


class Span(NamedTuple):
    """Documents with hashes from *low* to below *high* and *most* tokens at most."""

    low: int
    high: int
    most: int


class Plan(NamedTuple):
    """What a source gives: full copies of everything, and one more of what lies in its spans, which don't overlap."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    documents: int
    full: int
    spans: list[Span]


def sized(documents: DataFrame, sources: list[str], doc_id: str, text: str, source: str, tokenizer_path: str) -> DataFrame:
    """(doc_id, source, h, n_tokens) of the documents of the named sources, written once."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), bare(source).alias("source"), F.col(text).alias("text"))
    named = F.broadcast(documents.sparkSession.createDataFrame([(s,) for s in sources], "source string"))  # at most MOST_SOURCES rows
    docs = docs.join(named, "source", "left_semi").select("doc_id", "source", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _HASH_BITS).alias("h"), "text")

    def measure(key, name, h, body):
        yield key, name, h, tokens.count(body, tokenizer_path)

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return cut(per_row(docs, measure, f"doc_id {key_type}, source string, h bigint, n_tokens bigint"))


class Border(NamedTuple):
    """The document at which a source's extra copies end: thresholds with and without it, and the tokens below them."""

    without: int
    tokens_without: float
    including: int
    tokens_including: float
    hash: int  # -1 if all documents are taken


def _borders(measured: DataFrame, rest: dict[str, float], low: dict[str, int], most: dict[str, int]) -> dict[str, Border]:
    """For each source the threshold below which the tokens of documents from the hash *low* on, of *most* tokens at most, sum up to about *rest*.

    Each step meets the documents with a table of one row for each open source
    (its border bucket so far), sums up that bucket's parts, and finds the part
    on the border by a running sum within the source; the driver gets one row
    for each source.
    """
    spark = measured.sparkSession
    prefix = dict.fromkeys(rest, 0)  # the border bucket, as the leading bits of the hash
    below = dict.fromkeys(rest, 0)  # tokens under it
    done: dict[str, Border] = {}
    for step in range(1, STEPS + 1):
        open_ = [s for s in rest if s not in done]
        if not open_:
            break
        shift = _HASH_BITS - step * BUCKET_BITS
        at = spark.createDataFrame([(s, prefix[s], float(rest[s] - below[s]), low[s], most[s]) for s in open_], "source string, prefix bigint, wanted double, low bigint, most bigint")  # at most MOST_SOURCES rows
        inside = measured.join(F.broadcast(at), "source").where((F.shiftright("h", shift + BUCKET_BITS) == F.col("prefix")) & (F.col("h") >= F.col("low")) & (F.col("n_tokens") <= F.col("most")))
        parts = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.min("h").alias("h"), F.max("h").alias("last"), F.first("wanted").alias("wanted"))
        # at most 2**BUCKET_BITS parts for each source
        run = Window.partitionBy("source").orderBy("b")
        summed = parts.withColumn("upto", F.sum("t").over(run))
        border = F.when(F.col("upto") >= F.col("wanted"), F.struct("b", "t", "upto", "h", "last"))
        found = summed.groupBy("source").agg(F.min(border).alias("border"), F.max("upto").alias("every"))
        by = {r.source: r for r in found.collect()}
        for s in open_:
            r = by.get(s)
            if r is None or r.border is None:
                end = (prefix[s] + 1) << (shift + BUCKET_BITS)
                all_of_it = below[s] + (r.every if r else 0)
                done[s] = Border(end, all_of_it, end, all_of_it, -1)
                continue
            b, t, upto, first, last = r.border
            prefix[s], below[s] = b, below[s] + upto - t
            if first == last or step == STEPS:
                # one document (or equal hashes) on the border
                done[s] = Border(b << shift, below[s], (b + 1) << shift, below[s] + t, first)
    return done


def _spans(measured: DataFrame, rest: dict[str, float], budget: dict[str, float]) -> dict[str, list[Span]]:
    """The spans of each source whose tokens sum up to about *rest*."""
    out: dict[str, list[Span]] = {s: [] for s in rest}
    left = {s: r for s, r in rest.items() if r > 0}
    low, most = dict.fromkeys(rest, 0), dict.fromkeys(rest, 2**62)
    for level in range(LEVELS):
        again = {}
        for s, border in _borders(measured, left, low, most).items():
            short, over = left[s] - border.tokens_without, border.tokens_including - left[s]
            further = border.hash >= 0 and min(short, over) > TOLERANCE * budget[s] and level < LEVELS - 1
            out[s].append(Span(low[s], border.without if further or over >= short else border.including, most[s]))
            if further:
                again[s], low[s], most[s] = short, border.including, int(short)
        if not again:
            break
        left = again
    return out


def plan(measured: DataFrame, wanted: dict[str, tuple[float, int]], total_tokens: int | None = None) -> list[Plan]:
    """The largest set (or one of *total_tokens*) with the target shares; *wanted*: share and most repeats by source.

    Shares of targets without tokens go to the others in proportion.
    """
    held = {r.source: (r.t, r.n) for r in measured.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    able = {s: share for s, (share, most) in wanted.items() if share > 0 and most > 0 and held.get(s, (0, 0))[0] > 0}
    scale = sum(able.values())
    size = min((wanted[s][1] * held[s][0] * scale / share for s, share in able.items()), default=0.0)
    size = min(size, total_tokens) if total_tokens is not None else size
    full, rest, budgets = {}, {}, {}
    for s, share in able.items():
        budget = budgets[s] = size * share / scale
        full[s] = min(wanted[s][1], math.floor(budget / held[s][0] + 1e-9))
        rest[s] = budget - full[s] * held[s][0] if full[s] < wanted[s][1] else 0.0
    at = _spans(measured, {s: r if r > 0.5 else 0.0 for s, r in rest.items()}, budgets)
    return [Plan(s, share, most, *held.get(s, (0, 0)), full.get(s, 0), at.get(s, [])) for s, (share, most) in sorted(wanted.items())]


def clean_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats by bare source name; of repeated names the greatest share counts; null shares and repeats count as 0."""
    t = targets.select(bare("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where(F.col("source").isNotNull())
    rows = t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("m")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    return {r.source: (float(r.m.target_share), int(r.m.max_repeats)) for r in rows}


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer_path: str | None = None, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, n_tokens, copies), one row per document with at
    least one copy, never more copies than the source's max_repeats.  shares:
    (source, target_share, max_repeats, actual_share, tokens, documents,
    available_tokens, available_documents), one row per target.

    Source names are equal regardless of case and surrounding blanks.
    Documents of other or no sources stay out; null and empty texts have no
    tokens.  A target without documents gets an actual share of 0, and its
    share goes to the others in proportion.  Rows with equal ids share a hash
    and are chosen together.
    """
    wanted = clean_targets(targets)
    measured = sized(documents, sorted(wanted), doc_id, text, source, tokenizer_path or tokens.default_path())
    plans = plan(measured, wanted, total_tokens)
    spark = documents.sparkSession
    table = spark.createDataFrame(  # at most MOST_SOURCES rows
        [tuple(p) for p in plans], "source string, target_share double, max_repeats int, available_tokens bigint, available_documents bigint, full int, spans array<struct<low:bigint,high:bigint,most:bigint>>"
    )
    within = F.exists("spans", lambda x: (F.col("h") >= x["low"]) & (F.col("h") < x["high"]) & (F.col("n_tokens") <= x["most"]))
    copies = F.col("full") + F.when(within, 1).otherwise(0)
    chosen = measured.join(F.broadcast(table), "source").withColumn("copies", copies).where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")
    sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("bigint").alias("documents"))
    full = table.join(sums, "source", "left").na.fill(0, ["tokens", "documents"])
    every = full.agg(F.sum("tokens").alias("every")).scalar()
    shares = full.select(
        "source", "target_share", "max_repeats", F.when(every > 0, F.col("tokens") / every).otherwise(0.0).alias("actual_share"), "tokens", "documents", "available_tokens", "available_documents"
    )
    return chosen, shares


def expanded(chosen: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 1."""
    return chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

"""Order-dependent operators as window functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, family: str, key: str) -> DataFrame:
    """Places from 0 by key within each family."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(family).orderBy(key)) - 1)


#: Levels that a heading may have.
LEVELS = 6


def parent_headings(headings: DataFrame) -> DataFrame:
    """(doc_id, ordinal, level, parent): the ordinal of the nearest heading before with a smaller level; null below the document itself.

    Levels count from 1 to LEVELS.  Of the headings before one the last of each
    level is kept, whatever their number.
    """
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("ordinal")), ignorenulls=True).over(before)) for k in range(1, LEVELS)]
    return headings.withColumn("parent", F.greatest(*last))


def unique_anchors(headings: DataFrame) -> DataFrame:
    """Slugs made unique within a document: x, x-2, x-3; an empty one is ``section``."""
    base = F.when(F.coalesce("slug", F.lit("")) == "", "section").otherwise(F.col("slug"))
    n = F.row_number().over(Window.partitionBy("doc_id", base).orderBy("ordinal"))
    return headings.withColumn("anchor", F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string"))))


def section_ends(headings: DataFrame) -> DataFrame:
    """The last line of each section: that before the next heading, or the document's."""
    after = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return headings.withColumn("end_line", F.coalesce(after - 1, F.col("lines")))


def byte_budget(hits: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The leading rows of each group whose sizes sum up to the budget at most."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def chain_breaks(journal: DataFrame) -> DataFrame:
    """Records that don't follow on the one before: (run_id, sequence, problem).

    journal: (run_id, sequence, previous_digest, record_digest).  Sequences
    count from 1 without gaps; the first record has no previous digest.
    """
    w = Window.partitionBy("run_id").orderBy("sequence")
    seq, prev = F.lag("sequence").over(w), F.lag("record_digest").over(w)
    text = lambda c: F.coalesce(c, F.lit(""))
    problem = F.when(F.col("sequence") != F.coalesce(seq + 1, F.lit(1)), "gap").when(text(F.col("previous_digest")) != text(prev), "broken")
    return journal.select("run_id", "sequence", problem.alias("problem")).where(F.col("problem").isNotNull())


def run_summaries(journal: DataFrame) -> DataFrame:
    """(run_id, state, first_at, last_at, last_sequence, interrupted), newest first: a run without a final event was interrupted."""
    last = F.max(F.struct("sequence", "event", "at"))
    out = journal.groupBy("run_id").agg(last.alias("l"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    final = F.col("l.event").isin("run_succeeded", "run_failed", "run_cancelled")
    return out.select("run_id", F.col("l.event").alias("state"), "first_at", "last_at", F.col("l.sequence").alias("last_sequence"), (~final).alias("interrupted")).orderBy(F.col("last_at").desc(), "run_id")


def packs(records: DataFrame, group: str, order: str, most: int, header: int = 0, least: int = 200) -> DataFrame:
    """(group, order, part): records of a group packed in order into parts of at most *most* bytes.

    A part is closed before a record that would exceed it, if it already holds
    more than *least* bytes; its header counts; a record over the size stays
    whole.  The reset depends on what went before, so each group's sizes (two
    numbers per record, no text) are walked through once, in batches, in order.
    records: (group, order, size).
    """
    kinds = dict(records.dtypes)
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, part bigint"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, part = None, 0, 0
        for pdf in batches:
            out = []
            for g, s in zip(pdf[group], pdf["size"], strict=True):
                if g != at:
                    at, used, part = g, header, 1
                if used + s > most and used > least:
                    part, used = part + 1, header
                used += s
                out.append(part)
            yield pd.DataFrame({group: pdf[group], order: pdf[order], "part": out})

    placed = records.select(group, order, F.col("size")).repartition(group).sortWithinPartitions(group, order)
    return placed.mapInPandas(walk, schema)

"""Work that needn't be done again: per-file keys, plans, and the upkeep of the cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_key(stage: str, version: str, inputs: list[str], config: str) -> str:
    """The key of a stage's result: its name and version, the sorted digests of its inputs, its configuration."""
    return hashlib.sha256("\x00".join([stage, version, *sorted(inputs), config]).encode()).hexdigest()


def file_keys(files: DataFrame, extractor: str, version: str) -> DataFrame:
    """files (path, sha256) with the key under which an extractor's rows are kept."""
    return files.withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(extractor), F.lit(version), "path", "sha256"), 256))


def stale_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose key has no result yet. done: (key)."""
    return files.join(done.select("key").distinct(), "key", "left_anti")


def reusable(files: DataFrame, results: DataFrame) -> DataFrame:
    """Kept rows of files that haven't changed. results: with key."""
    return results.join(files.select("key").distinct(), "key", "left_semi")


def plan(files: DataFrame, done: DataFrame) -> DataFrame:
    """(disposition, files, bytes): what a run would restore and what it would do. files: with key and size_bytes."""
    flag = done.select("key").distinct().withColumn("_done", F.lit(True))
    out = files.join(flag, "key", "left")
    return out.groupBy(F.when(F.col("_done"), "restore").otherwise("run").alias("disposition")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def prune(entries: DataFrame, before) -> tuple[DataFrame, DataFrame]:
    """(entries to drop, objects that no remaining entry needs). entries: (key, object_digest, last_access, size_bytes); *before* None drops all."""
    old = F.lit(True) if before is None else F.col("last_access") < F.lit(before)
    drop = entries.where(old)
    kept = entries.where(~old).select("object_digest").distinct()
    return drop, drop.select("object_digest", "size_bytes").distinct().join(kept, "object_digest", "left_anti")


def inspect(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: entries, those without or with another object, objects without entry, bytes. objects: (object_digest, actual_digest, size_bytes)."""
    met = entries.select("key", "object_digest").join(objects, "object_digest", "full_outer")
    missing = F.col("key").isNotNull() & F.col("actual_digest").isNull()
    return met.agg(
        F.count("key").alias("entries"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("key").isNotNull() & (F.col("actual_digest") != F.col("object_digest"))).alias("corrupt"),
        F.count_if(F.col("key").isNull()).alias("orphans"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )


def verified(results: DataFrame, sums: DataFrame) -> DataFrame:
    """Kept results whose digest is still right; the others have to be made again. results: (key, digest); sums: (key, digest)."""
    return results.join(sums, ["key", "digest"], "left_semi")

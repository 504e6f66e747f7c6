"""Snapshots as immutable folders with a pointer to the current one.

A build writes families to a staging folder, is validated, and is published by
moving the folder and replacing the pointer file, which names the parent it
was built on.  A build whose parent is no longer current is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import row_digest, set_digest
from .validate import violations

# Open builds at a time and records per batch.
MOST_BUILDS, MOST_BATCH = 4, 10_000


class StoreError(RuntimeError):
    """conflict, invalid, limit or missing."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("staging", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    # -- files --

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def _write(self, name: str, held: dict) -> None:
        fresh, at = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(at):
            self._fs.delete(at, False)
        self._fs.rename(fresh, at)

    def _read(self, name: str) -> dict | None:
        if not self._exists(name):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    def _list(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")) if s.isDirectory())

    # -- reading --

    def current(self) -> str | None:
        held = self._read("CURRENT.json")
        return held and held["snapshot"]

    def snapshots(self) -> list[dict]:
        """All published snapshots, newest first, then by id."""
        rows = [self._read(f"snapshots/{s}/HEADER.json") for s in self._list("snapshots")]
        return sorted((r for r in rows if r), key=lambda r: (-r["published_at"], r["snapshot"]))

    def read(self, snapshot: str, family: str) -> DataFrame:
        if not self._exists(f"snapshots/{snapshot}/{family}"):
            raise StoreError("missing", f"{snapshot}/{family}")
        return self.spark.read.parquet(f"{self.folder}/snapshots/{snapshot}/{family}")

    def get(self, snapshot: str, family: str, record: str):
        """One record by id: a filter that reaches the Parquet statistics."""
        return self.read(snapshot, family).where(F.col("id") == record).first()

    # -- writing --

    def begin(self, parent: str | None) -> str:
        if parent != self.current():
            raise StoreError("conflict", "the parent is not current")
        if len(self._list("staging")) >= MOST_BUILDS:
            raise StoreError("limit", f"{MOST_BUILDS} builds are open")
        build = uuid.uuid4().hex
        self._fs.mkdirs(self._path(f"{self.folder}/staging/{build}"))
        self._write(f"staging/{build}/BUILD.json", {"parent": parent})
        return build

    def put(self, build: str, family: str, rows: DataFrame) -> None:
        """Append records; an id that is there already, or twice, is a conflict and nothing is added."""
        if not self._exists(f"staging/{build}"):
            raise StoreError("missing", build)
        at = f"{self.folder}/staging/{build}/{family}"
        if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").take(1):
            raise StoreError("conflict", f"{family}: repeated id")
        if self._exists(f"staging/{build}/{family}") and rows.join(self.spark.read.parquet(at).select("id"), "id", "left_semi").take(1):
            raise StoreError("conflict", f"{family}: id exists")
        rows.write.mode("append").parquet(at)

    def _families(self, build: str) -> dict[str, DataFrame]:
        return {f: self.spark.read.parquet(f"{self.folder}/staging/{build}/{f}") for f in self._list(f"staging/{build}")}

    def validate(self, build: str) -> DataFrame:
        return violations(self._families(build))

    def digest(self, build: str) -> str:
        """A digest of all records, whatever their order."""
        parts = [f"{f}={df.agg(set_digest(row_digest(*[F.to_json(F.struct(*sorted(df.columns)))])).alias('d')).first().d}" for f, df in sorted(self._families(build).items())]
        return self.spark.range(1).select(F.sha2(F.lit("\n".join(parts)), 256).alias("d")).first().d

    def commit(self, build: str) -> str:
        """Publish a build without errors whose parent is still current; returns the snapshot's id."""
        held = self._read(f"staging/{build}/BUILD.json")
        if held is None:
            raise StoreError("missing", build)
        if held["parent"] != self.current():
            raise StoreError("conflict", "another build was published")
        bad = self.validate(build).where("severity = 'error'").orderBy("code", "subject").take(1)
        if bad:
            raise StoreError("invalid", f"{bad[0].code} {bad[0].subject}")
        digest = self.digest(build)
        snapshot = f"s-{digest[:24]}"
        if self._exists(f"snapshots/{snapshot}"):
            snapshot = f"{snapshot}-{build[:8]}"
        self._write(f"staging/{build}/HEADER.json", {"snapshot": snapshot, "parent": held["parent"], "digest": digest, "published_at": time.time()})
        self._fs.rename(self._path(f"{self.folder}/staging/{build}"), self._path(f"{self.folder}/snapshots/{snapshot}"))
        self.set_current(snapshot)
        return snapshot

    def set_current(self, snapshot: str) -> None:
        if not self._exists(f"snapshots/{snapshot}"):
            raise StoreError("missing", snapshot)
        self._write("CURRENT.json", {"snapshot": snapshot})

    def abort(self, build: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/staging/{build}"), True)

    def recover(self) -> list[str]:
        """Drop all builds that were left open."""
        left = self._list("staging")
        for b in left:
            self.abort(b)
        return left

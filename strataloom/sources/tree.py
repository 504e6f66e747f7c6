"""Scanning a source tree: one artifact row per file, with its inspection."""

from __future__ import annotations

import os
import posixpath
import stat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import basename, extension, line_count

# Languages by file name and by ending; media types by ending.
NAMES = {"dockerfile": "dockerfile", "makefile": "make", "cmakelists.txt": "cmake", "jenkinsfile": "groovy", "justfile": "make", "vagrantfile": "ruby", "requirements.txt": "requirements"}
ENDINGS = {
    "python": "py pyi", "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "c": "c h", "cpp": "cc cpp cxx hpp hh", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift",
    "scala": "scala", "shell": "sh bash", "powershell": "ps1", "sql": "sql", "graphql": "graphql gql", "protobuf": "proto", "hcl": "tf", "yaml": "yaml yml", "json": "json", "jsonl": "jsonl", "toml": "toml", "xml": "xml", "html": "html", "css": "css",
    "scss": "scss", "markdown": "md", "mdx": "mdx", "rst": "rst", "text": "txt", "jupyter": "ipynb",
}
MEDIA = {
    "text/x-python": "py pyi", "text/javascript": "js mjs cjs", "text/x-go": "go", "application/json": "json", "text/markdown": "md", "text/plain": "txt", "text/html": "html htm", "text/css": "css", "application/xml": "xml", "application/yaml": "yaml yml",
    "application/toml": "toml", "text/csv": "csv", "application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg jpeg", "image/svg+xml": "svg", "application/zip": "zip", "application/gzip": "gz",
}
#: Sizes beyond which a file isn't read, or not as text; bytes that tell text from binary.
MOST_FILE, MOST_TEXT, PREVIEW = 1 << 30, 2 << 20, 8192


def _by_ending(table: dict[str, str]) -> Column:
    flat = [x for value, ends in table.items() for e in ends.split() for x in (F.lit("." + e), F.lit(value))]
    return F.create_map(*flat)


def detect_language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, F.lower(basename(path))), F.element_at(_by_ending(ENDINGS), extension(path)), F.lit(""))


def detect_media(path: Column) -> Column:
    return F.coalesce(F.element_at(_by_ending(MEDIA), extension(path)), F.lit("application/octet-stream"))


def likely_text(raw: bytes) -> bool:
    """Empty is text, a NUL is binary, valid UTF-8 is text; else under 3 % control bytes."""
    if not raw:
        return True
    if b"\x00" in raw:
        return False
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return sum(b < 9 or 14 <= b <= 31 for b in raw) / len(raw) < 0.03


@F.pandas_udf(BooleanType())
def text_preview(preview: pd.Series) -> pd.Series:
    return preview.map(lambda b: likely_text(bytes(b or b"")))


def excluded_by(path: Column, patterns: list[str]) -> Column:
    """The first pattern that a path equals or lies below; null if none."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when((path == p) | path.startswith(p + "/"), p).otherwise(out)
    return out


def inspect(files: DataFrame, most_file: int = MOST_FILE, most_text: int = MOST_TEXT) -> DataFrame:
    """files (path, size_bytes, content binary or null) with sha256, status, text, line_count, language and media_type.

    Statuses: oversized, unreadable, binary or text.  A text beyond *most_text* is oversized too.
    """
    big = F.col("size_bytes") > most_file
    raw = F.when(~big, F.col("content"))
    looks = text_preview(F.substring(raw, 1, PREVIEW)) & F.is_valid_utf8(raw)
    status = F.when(big, "oversized").when(raw.isNull(), "unreadable").when(~looks, "binary").when(F.col("size_bytes") > most_text, "oversized").otherwise("text")
    out = files.withColumn("status", status).withColumn("sha256", F.when(raw.isNotNull(), F.sha2(raw, 256)))
    text = F.col("status") == "text"
    return out.select("path", "size_bytes", "sha256", "status", text.alias("text"), F.when(text, line_count(F.decode("content", "UTF-8"))).alias("line_count"), detect_language(F.col("path")).alias("language"), detect_media(F.col("path")).alias("media_type"))


def listing(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """(path, kind, size_bytes, target) of all entries of a tree that all executors can read.

    The driver walks directories only; their entries are read by tasks.
    Excluded directories are pruned; kind is file, symlink or special.
    """
    base = root.rstrip("/")
    folders = []
    for at, dirs, _ in os.walk(base):
        rel = os.path.relpath(at, base)
        rel = "" if rel == "." else rel
        dirs[:] = sorted(d for d in dirs if not any((p := posixpath.join(rel, d)) == e or p.startswith(e + "/") for e in excludes or []))
        folders.append((rel,))

    def entries(batches):
        for pdf in batches:
            rows = []
            for rel in pdf["folder"]:
                with os.scandir(os.path.join(base, rel)) as found:
                    for e in found:
                        mode, path = e.stat(follow_symlinks=False), posixpath.join(rel, e.name)
                        if stat.S_ISLNK(mode.st_mode):
                            rows.append((path, "symlink", 0, os.readlink(e.path)))
                        elif stat.S_ISREG(mode.st_mode):
                            rows.append((path, "file", mode.st_size, ""))
                        elif not stat.S_ISDIR(mode.st_mode):
                            rows.append((path, "special", 0, ""))
            yield pd.DataFrame(rows, columns=["path", "kind", "size_bytes", "target"])

    return spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 200)).mapInPandas(entries, "path string, kind string, size_bytes bigint, target string")


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None, **sizes: int) -> DataFrame:
    """Artifacts of a tree: files by ``binaryFile``; empty files, links and special files, which it leaves out or follows, by ``listing``.

    Files below excluded paths are inspected, but have the status ``excluded``
    and the reason.
    """
    base = root.rstrip("/")
    listed = listing(spark, base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", rf"^(?:file:)?/*{base.lstrip('/')}/", "")
    links = listed.where(F.col("kind") != "file")
    rows = files.select(rel.alias("path"), F.col("length").alias("size_bytes"), "content").join(links, "path", "left_anti")
    empty = listed.where((F.col("kind") == "file") & (F.col("size_bytes") == 0)).select("path", "size_bytes", F.lit(b"").alias("content"))
    out = inspect(rows.unionByName(empty), **sizes).withColumn("kind", F.lit("file"))
    none = lambda kind: F.lit(None).cast(kind)
    others = links.select("path", "size_bytes", none("string").alias("sha256"), F.lit("recorded").alias("status"), F.lit(False).alias("text"), none("bigint").alias("line_count"), F.lit("").alias("language"), F.lit("").alias("media_type"), "kind")
    out = out.unionByName(others).withColumn("exclusion_reason", excluded_by(F.col("path"), excludes or []))
    return out.withColumn("status", F.when(F.col("exclusion_reason").isNotNull(), "excluded").otherwise(F.col("status")))


def inventory_digest(artifacts: DataFrame) -> DataFrame:
    """One row: the digest of (path, sha256, status, reason) of all artifacts, whatever their order."""
    from ..functions.ids import row_digest, set_digest

    return artifacts.agg(set_digest(row_digest(F.col("path"), F.col("sha256"), F.col("status"), F.col("exclusion_reason"))).alias("digest"))

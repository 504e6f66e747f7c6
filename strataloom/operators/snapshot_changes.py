"""What changed between full snapshots, by bucketed key-to-hash indexes.

A listing is reduced to index entries: for each (version, key) a 64-bit hash of
the compared fields, with the time of delivery.  Buckets are by key, so the
entry of a key in the last snapshot and the key's row in the next one lie in the
same bucket, and a delivery is compared bucket by bucket: the new rows probe the
bucket's index, keys that stay unmatched were removed, and the new rows become
the bucket's index.  Old and new values are fetched afterwards, for changed keys
alone (``fetch_values``).

``compare_lineage`` replays a whole history that way.  Histories are cut into
fragments of consecutive versions; one exchange brings the entries of a fragment
into its buckets, where the versions are delivered one after the other.  Only a
version whose child lies in another fragment is sent there too.
``IndexStore`` keeps the last index as a bucketed table, for deliveries that
come one by one, and swaps it after each; the table itself isn't shuffled.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut

#: Versions in a fragment of a history, and index entries that a bucket holds on average.
FRAGMENT_VERSIONS, BUCKET_ROWS = 64, 100_000
#: So many rows that say where versions go are broadcast; more meet the entries in a join, where a version of more than SALT_ROWS entries is spread over keys.
MOST_ROLES, SALT_ROWS = 50_000, 1_000_000


def row_hash(fields: list[Column]) -> Column:
    """xxhash64 of the fields; null and '' count as equal."""
    return F.xxhash64(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def bare_digest(col: Column) -> Column:
    """A digest without case, blanks and a leading ``sha256:``."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), "^sha256:", "")


def index_rows(df: DataFrame, version: Column, key: Column, fields: list[Column], order: Column | None = None) -> DataFrame:
    """(version, key, at, hash): the index entries of a listing, not yet deduplicated.

    Rows without a version or key are left out.  *order*: of the rows of one
    key the one with the greatest counts; ties go to the greatest hash.
    """
    at = F.lit(0).cast("bigint") if order is None else F.coalesce(F.unix_micros(order.cast("timestamp")), F.lit(-(2**62)))
    return df.select(version.alias("version"), key.alias("key"), at.alias("at"), row_hash(fields).alias("hash")).where(F.col("version").isNotNull() & F.col("key").isNotNull())


def _fragments(lineage: DataFrame, counts: DataFrame, fragment_versions: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """The numbered comparisons, and (version, frag, new, old, buckets): where a version's entries go, as numbers of the comparisons that they serve.

    new: the comparison in which the version is the new side; old: those in
    which it is the last snapshot.  Versions are numbered in the order of
    *place*, so neighbours in a history mostly share a fragment.
    """
    # the numbers of partitions and of rows within them; written once, so that they hold
    parts = max(1, math.ceil(lineage.count() / (100 * fragment_versions)))
    numbered = lineage.repartitionByRange(parts, "place", "version").sortWithinPartitions("place", "version").withColumn("target", F.monotonically_increasing_id())
    numbered = cut(numbered.withColumn("frag", F.floor(F.col("target") / fragment_versions)))
    # a version that many others follow goes to each of their fragments once, with all that it serves there
    news = numbered.select("version", "frag", F.col("target").alias("new"), F.lit(None).cast("bigint").alias("old"))
    olds = numbered.select(F.col("parent").alias("version"), "frag", F.lit(None).cast("bigint").alias("new"), F.col("target").alias("old"))
    roles = news.unionByName(olds).groupBy("version", "frag").agg(F.max("new").alias("new"), F.collect_list("old").alias("old"))  # at most FRAGMENT_VERSIONS a fragment
    sized = roles.join(counts, "version")
    buckets = sized.groupBy("frag").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / bucket_rows)).cast("int").alias("buckets"))
    return numbered, cut(sized.join(buckets, "frag").select("version", "frag", "new", "old", "buckets"))


def _deliver(table: pa.Table) -> pa.Table:
    """All comparisons of one bucket: (target, family, key, change_kind)."""
    n = table.num_rows
    keys = pc.binary_join_element_wise(table["family"], table["key"], "\x00").combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    version = table["version"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at, digest = table["at"].to_numpy(), table["hash"].to_numpy()
    # of repeats of a key in a version the last one counts
    order = np.lexsort((digest, at, code, version))
    last = np.ones(n, dtype=bool)
    last[:-1] = (version[order][1:] != version[order][:-1]) | (code[order][1:] != code[order][:-1])
    order = order[last]
    version, code, digest = version[order], code[order], digest[order]
    new = table["new"].to_numpy(zero_copy_only=False)[order]
    starts = np.flatnonzero(np.concatenate([[True], version[1:] != version[:-1]]))
    ends = np.concatenate([starts[1:], [len(version)]])
    indexes = {int(v): (code[s:e], digest[s:e]) for v, s, e in zip(version[starts], starts, ends, strict=True)}
    olds = table["old"].combine_chunks()
    came = {}  # comparison: the new side's version
    before = {}  # comparison: the last snapshot's version
    for v, s in zip(version[starts].tolist(), starts.tolist(), strict=True):
        if new[s] == new[s]:
            came[int(new[s])] = v
        for target in olds[int(order[s])].as_py():
            before[target] = v
    targets, codes, kinds = [], [], []

    def tell(target: int, some: np.ndarray, kind: str) -> None:
        targets.append(np.full(len(some), target, dtype=np.int64))
        codes.append(some)
        kinds.append(np.full(len(some), kind, dtype=object))

    nothing = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    for target in sorted({*came, *before}):
        # the last snapshot's index, sorted by key, is probed with the rows delivered
        index, values = indexes.get(before.get(target, -1), nothing)
        rows, fresh = indexes.get(came.get(target, -1), nothing)
        place = np.searchsorted(index, rows)
        known = place < len(index)
        known[known] = index[place[known]] == rows[known]
        tell(target, rows[~known], "added")
        hit = place[known]
        tell(target, rows[known][values[hit] != fresh[known]], "modified")
        gone = np.ones(len(index), dtype=bool)
        gone[hit] = False
        tell(target, index[gone], "removed")
    if not targets:
        return _CHANGES.empty_table()
    first = np.full(len(keys.dictionary), -1, dtype=np.int64)
    first[code[::-1]] = order[::-1]
    row = pa.array(first[np.concatenate(codes)])
    return pa.table([pa.array(np.concatenate(targets)), table["family"].take(row), table["key"].take(row), pa.array(np.concatenate(kinds), type=pa.string())], schema=_CHANGES)


_CHANGES = pa.schema([("target", pa.int64()), ("family", pa.string()), ("key", pa.string()), ("change_kind", pa.string())])


def compare_lineage(index: DataFrame, lineage: DataFrame, fragment_versions: int = FRAGMENT_VERSIONS, bucket_rows: int = BUCKET_ROWS, most_roles: int = MOST_ROLES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Changes of every version against its parent.

    index: (version, family, key, at, hash); lineage: (version, parent[,
    place]), one row per version to compare; *place* orders versions so that
    neighbours in a history lie together, and affects speed only.  Returns
    (version, family, key, change_kind) with ``added``, ``removed`` or
    ``modified``; equal keys give no row.  A version without entries counts
    as empty.
    """
    placed = lineage.select("version", "parent", F.coalesce(F.col("place"), F.lit("")).alias("place") if "place" in lineage.columns else F.lit("").alias("place"))
    counts = cut(index.groupBy("version").agg(F.count("*").alias("n")))
    numbered, roles = _fragments(placed, counts, fragment_versions, bucket_rows)
    if roles.limit(most_roles + 1).count() <= most_roles:
        met = index.join(F.broadcast(roles), "version")
    else:
        # versions of very many entries; fewer than 100 000, as each holds more than that part of all
        part = counts.agg(F.sum("n")).first()[0] / 100_000
        large = F.broadcast(counts.where(F.col("n") > max(salt_rows, part)).select("version", F.ceil(F.col("n") / salt_rows).cast("int").alias("_salts")))
        salts = F.coalesce("_salts", F.lit(1))
        spread = index.join(large, "version", "left").withColumn("_salt", F.pmod(F.xxhash64("key"), salts).cast("int")).drop("_salts")
        many = roles.join(large, "version", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        met = spread.join(many, ["version", "_salt"]).drop("_salt")
    sent = met.withColumn("bucket", F.pmod(F.xxhash64("family", "key"), F.col("buckets")).cast("int"))
    # a version travels as the number of a comparison that it takes part in
    sent = sent.withColumn("version", F.coalesce(F.col("new"), -1 - F.element_at("old", 1)))
    changes = sent.select("frag", "bucket", "version", "family", "key", "at", "hash", "new", "old").groupBy("frag", "bucket").applyInArrow(_deliver, "target bigint, family string, key string, change_kind string")
    return changes.join(numbered.select("target", "version"), "target").select("version", "family", "key", "change_kind")


def fetch_values(changes: DataFrame, rows: DataFrame, lineage: DataFrame, values: list[str]) -> DataFrame:
    """Old and new values of changed keys only.

    rows: (version, key, *values), one per version and key.  Returns the
    changes with ``old`` and ``new`` structs (null where there is none) and
    ``changed``, the names of the differing fields in the order of *values*.
    """
    pack = F.struct(*values)
    side = rows.select(F.col("version").alias("at_version"), F.col("key").alias("at_key"), pack.alias("v"))
    with_parent = changes.join(lineage, "version")
    new = with_parent.join(side.withColumnRenamed("v", "new"), (F.col("version") == F.col("at_version")) & (F.col("key") == F.col("at_key")), "left").drop("at_version", "at_key")
    both = new.join(side.withColumnRenamed("v", "old"), (F.col("parent") == F.col("at_version")) & (F.col("key") == F.col("at_key")), "left").drop("at_version", "at_key")
    same = lambda v: F.coalesce(F.col(f"old.{v}").cast("string"), F.lit("")) == F.coalesce(F.col(f"new.{v}").cast("string"), F.lit(""))
    changed = F.array_compact(F.array(*[F.when(~same(v), F.lit(v)) for v in values]))
    return both.withColumn("changed", F.when(F.col("change_kind") == "modified", changed).otherwise(F.array().cast("array<string>")))


class IndexStore:
    """The key-to-hash index of the last delivered snapshot, kept as a bucketed table.

    ``advance`` probes it with the rows of the next snapshot and swaps it: only
    the new rows are shuffled, into the buckets of the index.  Indexes are
    numbered folders, and the one with the greatest number that is marked as
    complete is in force, so no moment is without one: a delivery that fails
    midway leaves the old index in force.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        """The number of the index in force."""
        if not self._fs.exists(self._path(self.folder)):
            return None
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(n.removeprefix("DONE-")) for n in names if n.startswith("DONE-")]
        return max(numbers, default=None)

    def _table(self, number: int, schema: StructType, keys: list[str]) -> DataFrame:
        """The bucketed table over an index folder."""
        name = f"strataloom_index_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/index-{number}'")
        return self.spark.table(name)

    def advance(self, rows: DataFrame, keys: list[str], fields: list[str], changes_to: str) -> DataFrame:
        """Changes of *rows* against the last delivery, written to *changes_to*.

        Returns (keys, change_kind).  The first delivery adds everything.  Rows
        with a null key are left out; repeats of a key count once, by greatest
        hash.
        """
        old = self.current()
        number = 0 if old is None else old + 1
        fresh = rows.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x)).groupBy(*keys).agg(F.max(row_hash([F.col(f) for f in fields])).alias("hash"))
        self._fs.delete(self._path(f"{self.folder}/index-{number}"), True)  # of a delivery that failed
        name = f"strataloom_index_{uuid.uuid4().hex}"
        # in the partitions of the buckets, so that each bucket is one file
        fresh.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).format("parquet").option("path", f"{self.folder}/index-{number}").saveAsTable(name)
        new = self.spark.table(name)
        if old is None:
            changes = new.select(*keys, F.lit("added").alias("change_kind"))
        else:
            last = self._table(old, fresh.schema, keys).withColumnRenamed("hash", "old_hash")
            kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old_hash"), "modified")
            changes = probed(new, last, keys).select(*keys, kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
        changes.write.mode("overwrite").parquet(changes_to)
        self._fs.create(self._path(f"{self.folder}/DONE-{number}"), True).close()
        if old is not None:
            self._fs.delete(self._path(f"{self.folder}/DONE-{old}"), False)
            self._fs.delete(self._path(f"{self.folder}/index-{old}"), True)
        return self.spark.read.schema(changes.schema).parquet(changes_to)


def probed(new: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """The new index joined to the last one, bucket by bucket."""
    return new.hint("merge").join(last, keys, "full_outer")

from pyspark.sql import functions as F

from strataloom.operators.snapshot_changes import IndexStore, bare_digest, compare_lineage, fetch_values, index_rows


def test_lineage_changes(spark):
    rows = [
        ("s1", "a", "1", 1), ("s1", "b", "1", 1), ("s1", "c", None, 1), ("s1", "c", "9", 0),
        ("s2", "a", "1", 1), ("s2", "a", "1", 1), ("s2", "c", "", 1), ("s2", "d", "x", 1), (None, "z", "1", 1), ("s2", None, "1", 1),
        ("s3", "a", "2", 1), ("s3", "b", "1", 1), ("s3", "c", "", 1),
    ]
    df = spark.createDataFrame(rows, "version string, k string, hash string, at int")
    index = index_rows(df, F.col("version"), F.col("k"), [F.col("hash")], F.timestamp_seconds("at")).withColumn("family", F.lit("f"))
    lineage = spark.createDataFrame([("s2", "s1"), ("s3", "s1")], "version string, parent string")
    changes = compare_lineage(index, lineage)
    for how in ({"fragment_versions": 1, "bucket_rows": 2}, {"fragment_versions": 2, "most_roles": 0, "salt_rows": 2}):
        again = compare_lineage(index, lineage, **how)
        assert again.exceptAll(changes).collect() == [] and again.count() == changes.count()
    assert {tuple(r) for r in changes.collect()} == {("s2", "f", "b", "removed"), ("s2", "f", "d", "added"), ("s3", "f", "a", "modified")}
    latest = df.where("k is not null and version is not null").groupBy("version", F.col("k").alias("key")).agg(F.max_by("hash", "at").alias("hash"))
    full = {(r.version, r.key): (r.old and r.old.hash, r.new and r.new.hash, r.changed) for r in fetch_values(changes, latest, lineage, ["hash"]).collect()}
    assert full == {("s2", "b"): ("1", None, []), ("s2", "d"): (None, "x", []), ("s3", "a"): ("1", "2", ["hash"])}
    assert compare_lineage(index.limit(0), lineage).collect() == []


def test_bare_digest(spark):
    df = spark.createDataFrame([("SHA256:AB",), ("sha256:ab",), (" ab ",), (None,), ("",)], "d string")
    assert [r[0] for r in df.select(bare_digest(F.col("d"))).collect()] == ["ab", "ab", "ab", "", ""]


def test_index_store_swaps(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "idx"), buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, bucket int, v string")
    kinds = lambda df: {(r.k, r.change_kind) for r in df.collect()}
    assert kinds(store.advance(make([("a", 1, "1"), ("b", 1, "1"), (None, 1, "1")]), ["k"], ["v"], str(tmp_path / "c1"))) == {("a", "added"), ("b", "added")}
    assert kinds(store.advance(make([("a", 1, "2"), ("c", 1, None), ("c", 1, None)]), ["k"], ["v"], str(tmp_path / "c2"))) == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert kinds(store.advance(make([("a", 1, "2"), ("c", 1, "")]), ["k"], ["v"], str(tmp_path / "c3"))) == set()
    assert kinds(store.advance(make([]), ["k"], ["v"], str(tmp_path / "c4"))) == {("a", "removed"), ("c", "removed")}


def test_only_new_rows_are_shuffled_to_the_index(spark, tmp_path):
    from strataloom.operators.snapshot_changes import probed

    store = IndexStore(spark, str(tmp_path / "idx"), buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    store.advance(make([("a", "1")]), ["k"], ["v"], str(tmp_path / "c1"))
    store.advance(make([("a", "2")]), ["k"], ["v"], str(tmp_path / "c2"))
    assert store.current() == 1
    schema = make([]).selectExpr("k", "1L as hash").schema
    plan = probed(store._table(1, schema, ["k"]), store._table(1, schema, ["k"]).withColumnRenamed("hash", "old_hash"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    # a delivery that fails leaves the index in force
    broken = make([("b", "1")]).selectExpr("k", "raise_error('late') as v")
    try:
        store.advance(broken, ["k"], ["v"], str(tmp_path / "c3"))
        raise AssertionError("no error")
    except Exception as e:
        assert "late" in str(e)
    assert store.current() == 1
    assert {tuple(r) for r in store.advance(make([("a", "2"), ("b", "")]), ["k"], ["v"], str(tmp_path / "c4")).collect()} == {("b", "added")}


def test_histories_of_many_forms(spark):
    """Chains, stars and branches against plain Python, whatever the fragments."""
    import random

    rnd = random.Random(4)
    parents = {f"v{i}": f"v{rnd.choice([i - 1, 0, rnd.randrange(i)])}" for i in range(1, 60)}
    lists = {}
    for i in range(60):
        base = dict(lists.get(parents.get(f"v{i}"), {}))
        for _ in range(4):
            base[f"k{rnd.randrange(20)}"] = str(rnd.randrange(5))
        for k in [k for k in base if rnd.random() < 0.1]:
            del base[k]
        lists[f"v{i}"] = base
    rows = [(v, k, x) for v, held in lists.items() for k, x in held.items()]
    df = spark.createDataFrame(rows, "version string, k string, hash string")
    index = index_rows(df, F.col("version"), F.col("k"), [F.col("hash")]).withColumn("family", F.lit("f"))
    lineage = spark.createDataFrame([(v, p, v) for v, p in parents.items()], "version string, parent string, place string")
    want = set()
    for v, p in parents.items():
        for k in {*lists[v], *lists[p]}:
            old, new = lists[p].get(k), lists[v].get(k)
            if old != new:
                want.add((v, "f", k, "added" if old is None else "removed" if new is None else "modified"))
    for how in ({}, {"fragment_versions": 7, "bucket_rows": 20}):
        got = [tuple(r) for r in compare_lineage(index, lineage, **how).collect()]
        assert set(got) == want and len(got) == len(want)

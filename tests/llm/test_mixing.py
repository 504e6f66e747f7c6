import pytest

from strataloom.llm import mixing as M


def docs(spark, spec):
    rows, i = [], 0
    for source, n, words in spec:
        for k in range(n):
            rows.append((i, " word" * (words + k % 3), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as target_share", "'x' as h")


def test_shares_and_caps(spark):
    d = docs(spark, [("a", 300, 20), (" A ", 20, 20), ("b", 100, 10), ("c", 50, 30), (None, 5, 9), ("other", 7, 9), ("hot", 900, 5)])
    t = spark.createDataFrame([("a", 0.4, 2), ("B", 0.2, 4), ("c", 0.2, 3), ("hot", 0.1, 1), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(d, t)
    s = {r.source: r for r in shares.collect()}
    every = sum(r.tokens for r in s.values())
    for name, share in (("a", 0.4), ("b", 0.2), ("c", 0.2), ("hot", 0.1)):
        assert abs(s[name].actual_share - share / 0.9) < 0.01, name
    assert s["none"].tokens == 0 and s["a"].available_documents == 320
    rows = chosen.collect()
    assert sum(r.n_tokens * r.copies for r in rows) == every and len({r.doc_id for r in rows}) == len(rows)
    caps = {"a": 2, "b": 4, "c": 3, "hot": 1}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    # some source is used up, so the set is the largest possible
    assert any(r.tokens >= 0.99 * caps[r.source] * r.available_tokens for r in s.values() if r.source in caps)
    assert M.expanded(chosen).count() == sum(r.copies for r in rows)


def test_long_documents_on_the_border(spark):
    rows = [(i, " word" * (3000 if i % 9 == 0 else 20), s) for s in ("a", "b") for i in range(1000 * (s == "b"), 1000 * (s == "b") + 400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    for total in (150_000, 61_234, 37_777):
        s = {r.source: r.actual_share for r in M.mix(d, t, total_tokens=total)[1].collect()}
        assert abs(s["a"] - 0.6) < 0.004, (total, s)


def test_smaller_sets_are_nested(spark):
    d = docs(spark, [("a", 200, 12), ("b", 200, 12)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    big = {r.doc_id for r in M.mix(d, t, total_tokens=3000)[0].collect()}
    small = {r.doc_id for r in M.mix(d, t, total_tokens=900)[0].collect()}
    assert small < big


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", "a")]])
def test_nothing_to_mix(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("z", None, None)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(d, t)
    assert chosen.collect() == [] and {r.source: r.actual_share for r in shares.collect()} == {"a": 0.0, "z": 0.0}


def test_equal_hashes_go_together(spark):
    d = spark.createDataFrame([(1, "one two three", "a")] * 4, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    chosen, _ = M.mix(d, t, total_tokens=5)
    assert len(chosen.collect()) in (0, 4)

import random

import pytest

from strataloom.operators import hierarchy as H


def brute(parent):
    out = {}
    known = {k: (p if p in parent else None) for k, p in parent.items()}
    for k in known:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = known[at]
        if at is None:
            out[k] = (seen[-1], len(seen) - 1, 0, seen[::-1])
        else:
            out[k] = (None, -1, 1 if at == k else 2, None)
    below = dict.fromkeys(known, 0)
    for k, (_, _, status, path) in out.items():
        if status == 0:
            for a in path[:-1]:
                below[a] += 1
    return {k: (r, d, below[k] if s == 0 else -1, s, p) for k, (r, d, s, p) in out.items()}


def forest(seed, n, cycles):
    rnd = random.Random(seed)
    parent = {}
    ids = [f"n{i:04d}" for i in range(n)]
    for i, k in enumerate(ids):
        pick = rnd.random()
        parent[k] = None if i == 0 or pick < 0.03 else ids[i - 1] if pick < 0.7 else rnd.choice(ids[:i]) if pick < 0.97 else "gone"
    for _ in range(cycles):
        a = rnd.choice(ids)
        parent[a] = rnd.choice(ids)
    return parent


@pytest.mark.parametrize("seed,n,cycles,rows", [(1, 60, 0, 10), (2, 80, 3, 9), (3, 50, 2, 1000), (4, 120, 6, 25)])
def test_against_brute_force(spark, seed, n, cycles, rows):
    parent = forest(seed, n, cycles)
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = H.hierarchy(df, locality="id", fragment_rows=rows, with_paths=True).collect()
    assert {r.id: (r.root, r.depth, r.n_descendants, r.status, r.path) for r in got} == brute(parent)


def scattered(parent):
    """The same forest under names without locality."""
    names = {k: f"{random.Random(k).random():.9f}" for k in parent}
    return {names[k]: names.get(p, p) for k, p in parent.items()}


STAR = {"hub": None} | {f"s{i:03d}": "hub" for i in range(90)} | {f"t{i}": f"s{i:03d}" for i in range(9)}
CHAIN = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(90)}
RING = {f"r{i:03d}": f"r{(i + 1) % 60:03d}" for i in range(60)} | {f"q{i}": f"r{i:03d}" for i in range(20)}


@pytest.mark.parametrize("name,parent", [("mixed", forest(6, 70, 2)), ("star", STAR), ("chain", CHAIN), ("ring", RING)])
@pytest.mark.parametrize("most_tops", [0, 1000])
def test_without_locality(spark, name, parent, most_tops):
    renamed = scattered(parent)
    df = spark.createDataFrame(list(renamed.items()), "id string, parent string")
    got = H.hierarchy(df, fragment_rows=12, with_paths=True, most_tops=most_tops).collect()
    assert {r.id: (r.root, r.depth, r.n_descendants, r.status, r.path) for r in got} == brute(renamed)


def test_a_star_leaves_no_quotient(spark, monkeypatch):
    sizes = []
    solve = H._solve
    monkeypatch.setattr(H, "_solve", lambda nodes, n, *rest: (sizes.append(n), solve(nodes, n, *rest))[1])
    df = spark.createDataFrame(list(scattered(STAR).items()), "id string, parent string")
    H.hierarchy(df, fragment_rows=12, unique=True).collect()
    assert sizes[0] == len(STAR) and max(sizes[1:]) < 25


def test_intervals(spark):
    parent = forest(9, 80, 2)
    tree = H.hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), with_paths=True)
    spans = {r.id: r for r in H.intervals(tree, fragment_rows=11).collect()}
    want = {k: v for k, v in brute(parent).items() if v[3] == 0}
    assert set(spans) == set(want)
    for a in want:
        under = {k for k, v in want.items() if a in v[4][:-1]}
        assert {k for k, r in spans.items() if r.root == spans[a].root and spans[a].first < r.first <= spans[a].last} == under
    assert H.intervals(tree.limit(0)).collect() == []


def test_edges(spark):
    rows = [("a", None, 1), ("a", None, 1), (None, "a", 2), ("self", "self", 3), ("b", "gone", 4), ("c", "a", 5), ("c", None, 6)]
    df = spark.createDataFrame(rows, "id string, parent string, depth int")
    got = {r.id: (r.root, r.depth, r.n_descendants, r.status) for r in H.hierarchy(df).collect()}
    assert got == {"a": ("a", 0, 1, 0), "self": (None, -1, -1, 1), "b": ("b", 0, 0, 0), "c": ("a", 1, 0, 0)}
    assert H.hierarchy(df.limit(0)).collect() == []


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {(r.id, r.descendant, r.distance) for r in H.descendants(H.hierarchy(df, with_paths=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}

import random

import pandas as pd
import pytest

from strataloom.operators import graph as G

EDGES = [
    ("ab", "calls", "a", "b", "declared"),
    ("ac", "imports", "a", "c", "resolved"),
    ("bd", "calls", "b", "d", "syntax_inferred"),
    ("cd", "calls", "c", "d", "unresolved"),
    ("da", "depends_on", "d", "a", "declared"),
    ("uu", "references", "u", "u", "declared"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "id string, kind string, `from` string, `to` string, resolution string")


@pytest.mark.parametrize(
    "options,depths,used,truncated",
    [
        (G.Options(), {"a": 0, "b": 1, "c": 1, "d": 1}, {"ab", "ac", "bd", "da"}, False),
        (G.Options("outgoing", 1), {"a": 0, "b": 1, "c": 1}, {"ab", "ac"}, False),
        (G.Options("incoming", 1), {"a": 0, "d": 1}, {"da"}, False),
        (G.Options("outgoing", 3, kinds=("calls",)), {"a": 0, "b": 1, "d": 2}, {"ab", "bd"}, False),
        (G.Options("outgoing", 2, resolutions=("compiler_resolved",)), {"a": 0, "c": 1}, {"ac"}, False),
        (G.Options("outgoing", 2, unresolved=True), {"a": 0, "b": 1, "c": 1, "d": 2}, {"ab", "ac", "bd", "cd"}, False),
        (G.Options("outgoing", 4, nodes=2), {"a": 0, "b": 1}, {"ab"}, True),
    ],
)
def test_neighborhood(edges, options, depths, used, truncated):
    n = G.neighborhood(edges, "a", options)
    assert {r.id: r.depth for r in n.nodes.collect()} == depths
    assert {r.id for r in n.edges.collect()} == used and n.truncated == truncated


def test_impact_and_paths(edges):
    assert {r.id for r in G.impact(edges, "d").nodes.collect()} == {"a", "b"}
    p = G.shortest_path(edges, "a", "d", G.Options("outgoing"))
    assert p == G.Path(True, ["a", "b", "d"], ["ab", "bd"], 4, False)
    assert G.shortest_path(edges, "a", "a").nodes == ["a"]
    assert not G.shortest_path(edges, "a", "u").found
    assert not G.shortest_path(edges, "a", "d", G.Options("outgoing", depth=1)).found


def brute_components(pairs, nodes):
    reach = {v: {v} for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for v in nodes:
                if a in reach[v] and b not in reach[v]:
                    reach[v].add(b)
                    changed = True
    return {v: min(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes}


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    rnd = random.Random(3)
    nodes = [f"v{i:02d}" for i in range(22)]
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(30)})
    df = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "`from` string, `to` string, kind string")
    got = G.strongly_connected(df, small_edges=small, nodes=spark.createDataFrame([("zz",)], "id string")).collect()
    used = sorted({x for p in pairs for x in p})
    want = brute_components(pairs, used) | {"zz": "zz"}
    assert {r.id: r.component for r in got} == want
    for r in got:
        members = [k for k, c in want.items() if c == r.component]
        assert r.size == len(members) and r.cyclic == (len(members) > 1 or (r.id, r.id) in pairs)
    assert G.strongly_connected(df, kinds=("imports",)).collect() == []


def test_tarjan_deep():
    n = 5000
    chain = pd.DataFrame({"from": [f"{i:05d}" for i in range(n)], "to": [f"{(i + 1) % n:05d}" for i in range(n)]})
    assert set(G._tarjan(chain)["size"]) == {n}


def test_small_parts(spark, edges):
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert {r.id for r in G.induced(edges, ids).collect()} == {"ab"}
    assert {(r.id, r.n_in, r.n_out) for r in G.incident(spark.createDataFrame([("a",), ("x",)], "id string"), edges).collect()} == {("a", 1, 2), ("x", 0, 0)}
    assert G.waves({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        G.waves({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        G.steps(edges, "sideways")

"""The graph queries against plain Python over all edges of the smallest data folder."""

import os

import pytest
from oracle import FOLDER

from strataloom.operators import retrieval as R
from strataloom.plans import all_queries, views

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
HITS = [("s:1", 3.0, True), ("n:3", 2.0, True), ("c:7", 1.0, False)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {r.id: r.kind for r in views.graph_nodes(spark, FOLDER).collect()}
    return nodes, views.graph_edges(spark, FOLDER).collect()


def one_by_one(nodes, edges, hops, limit, budget):
    """Each seed in turn walks breadth first over its sorted neighbours, within what is left of the budget."""
    near = {}
    for e in edges:
        if e.resolution != "unresolved":
            near.setdefault(e["from"], set()).add(e["to"])
            near.setdefault(e["to"], set()).add(e["from"])
    scores, why, left = {i: s for i, s, _ in HITS}, {}, budget
    for seed, score, is_node in HITS:
        if left <= 0 or not is_node:
            continue
        depths, queue = {seed: 0}, [seed]
        for at in queue:
            if depths[at] < hops:
                for b in sorted(near.get(at, ())):
                    if b not in depths and len(depths) < left:
                        depths[b] = depths[at] + 1
                        queue.append(b)
        left -= len(depths)
        for i, d in depths.items():
            if d and i in nodes:
                scores[i] = scores.get(i, 0.0) + score * 0.55**d
                why.setdefault(i, set()).add(f"graph_from:{seed}:depth:{d}")
    rows = [(i, round(s * 1e6) / 1e6, ",".join(sorted(why.get(i, ())))) for i, s in scores.items()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]


def test_graph_expand_takes_all_kinds(spark, graph):
    nodes, edges = graph
    got = [tuple(r) for r in all_queries()["graph_expand"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(one_by_one(nodes, edges, 2, 1000, 5000))
    assert any(r[0].startswith("o:") for r in got)


@pytest.mark.parametrize("budget", [40, 700, 1100])
def test_expand_budget_in_order_of_discovery(spark, graph, budget):
    nodes, edges = graph
    hits = spark.createDataFrame(HITS, "id string, score double, is_node boolean")
    got = R.expand(hits, views.graph_edges(spark, FOLDER), views.graph_nodes(spark, FOLDER), 2, 1000, budget=budget).hits.collect()
    assert sorted((r.id, r.score, ",".join(r.reasons)) for r in got) == sorted(one_by_one(nodes, edges, 2, 1000, budget))


def test_induced_subgraph_by_kind(spark, graph):
    nodes, edges = graph
    some = {i for i, kind in nodes.items() if kind in ("namespace", "module", "class")}
    got = {tuple(r) for r in all_queries()["induced_subgraph"](spark, FOLDER).collect()}
    assert got == {(e.id, e.kind) for e in edges if e["from"] in some and e["to"] in some}
    assert "c:100|references|n:" in {i[: i.rindex(":") + 1] for i, _ in got}

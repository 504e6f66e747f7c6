"""The registered walks reach every node, however many there are."""

import os

import pytest
from oracle import FOLDER, rows_by_sql, rows_of

from strataloom.operators import graph as G
from strataloom.plans import all_oracles, all_queries


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["neighborhood", "impact", "shortest_path"])
def test_beyond_the_cap(spark, name, monkeypatch):
    monkeypatch.setattr(G, "NODES_MOST", 20)
    assert rows_of(all_queries()[name](spark, FOLDER)) == rows_by_sql(all_oracles()[name])


def test_uncapped_walk(spark):
    edges = spark.createDataFrame([(f"s{i}", "calls", "s", f"m{i}", "declared") for i in range(60)] + [("x", "calls", "m59", "t", "declared")], "id string, kind string, `from` string, `to` string, resolution string")
    n = G.neighborhood(edges, "s", G.Options("outgoing", 2, nodes=5, capped=False))
    assert n.nodes.count() == 62 and not n.truncated and G.neighborhood(edges, "s", G.Options("outgoing", 2, nodes=5)).truncated
    assert G.shortest_path(edges, "s", "t", G.Options("outgoing", nodes=5, capped=False)).nodes == ["s", "m59", "t"]

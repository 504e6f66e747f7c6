"""The query surfaces in one place, each with its own defaults."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import packets as P
from .operators import records as R
from .operators import retrieval as S


class Defaults(NamedTuple):
    hood: G.Options
    path: G.Options
    impact: G.Options
    component_kinds: tuple[str, ...]
    strict_direction: bool  # whether an unknown direction is an error; else it counts as both


# Depths, sizes and directions of the surfaces.
SURFACES = {
    "engine": Defaults(G.Options("both", 4, 5000), G.Options("both", 4, 5000), G.Options("incoming", 4, 5000), (), True),
    "http": Defaults(G.Options("both", 1, 500), G.Options("both", 8, 10_000), G.Options("incoming", 4, 5000), (), False),
    "mcp": Defaults(G.Options("both", 2, 500), G.Options("both", 8, 5000), G.Options("incoming", 4, 5000), (), True),
    "cli": Defaults(G.Options("both", 4, 5000), G.Options("outgoing", 12, 10_000), G.Options("incoming", 4, 5000), ("calls", "imports", "depends_on"), True),
}
COMPONENTS_DEFAULT, COMPONENTS_MOST = 100, 10_000


class NotFound(KeyError):
    pass


class Ambiguous(KeyError):
    pass


class Catalogue:
    """Queries over one snapshot's families: nodes, edges, evidence, artifacts, diagnostics and search documents."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, search: DataFrame | None = None, surface: str = "engine"):
        self.nodes, self.edges, self.evidence, self.docs, self.defaults = nodes, edges, evidence, search, SURFACES[surface]

    def _id(self, reference: str) -> str:
        state, found = R.resolve_reference(self.nodes, reference)
        if state == "ambiguous":
            raise Ambiguous(reference)
        if found is None:
            raise NotFound(reference)
        return found

    def _options(self, base: G.Options, given: dict) -> G.Options:
        o = base._replace(**given)
        if o.direction not in ("outgoing", "incoming", "both"):
            if self.defaults.strict_direction:
                raise ValueError(f"direction {o.direction!r}")
            o = o._replace(direction="both")
        return o

    def search(self, text: str, **filters) -> DataFrame:
        return S.lexical_search(self.docs, S.Query(text, **filters))

    def symbol(self, reference: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the node, edges into it, edges out of it)."""
        i = self._id(reference)
        return self.nodes.where(F.col("id") == i), self.edges.where(F.col("to") == i).orderBy("from", "kind", "id"), self.edges.where(F.col("from") == i).orderBy("to", "kind", "id")

    def evidence_of(self, reference: str) -> DataFrame:
        return P.evidence_of(self.nodes.where(F.col("id") == self._id(reference)), self.evidence)

    def neighborhood(self, reference: str, **options) -> G.Neighborhood:
        return G.neighborhood(self.edges, self._id(reference), self._options(self.defaults.hood, options))

    def path(self, source: str, target: str, **options) -> G.Path:
        return G.shortest_path(self.edges, self._id(source), self._id(target), self._options(self.defaults.path, options))

    def impact(self, reference: str, **options) -> G.Neighborhood:
        return G.impact(self.edges, self._id(reference), self._options(self.defaults.impact, options))

    def components(self, kinds: tuple[str, ...] | None = None, limit: int = 0) -> DataFrame:
        """(component, size, cyclic), by the least member; at most *limit*."""
        n = COMPONENTS_DEFAULT if limit <= 0 else min(limit, COMPONENTS_MOST)
        each = G.strongly_connected(self.edges, self.defaults.component_kinds if kinds is None else kinds)
        return each.groupBy("component").agg(F.max("size").alias("size"), F.max("cyclic").alias("cyclic")).orderBy("component").limit(n)

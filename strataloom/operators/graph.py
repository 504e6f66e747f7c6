"""Graph traversal: bounded neighbourhoods, shortest paths, impact, strongly connected components.

Traversals go level by level.  A level looks the frontier up among the edges: a
small one by a pushed-down list of ids, one up to the cap by broadcast, so that
edges aren't shuffled, and a larger one (of an uncapped walk) by a shuffle.
Each level is written to the checkpoint folder once, so plans stay short and
survive lost executors.  Edges hold (id, kind, from, to, resolution); ``EdgeIndex``
keeps them on disk in both directions, sorted by the end that is looked up.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..vocabulary import normal_resolution

# Defaults and caps of traversals.
DEPTH_DEFAULT, DEPTH_MOST, NODES_DEFAULT, NODES_MOST = 4, 64, 5000, 100_000


class Options(NamedTuple):
    direction: str = "both"  # outgoing, incoming or both
    depth: int = 0
    nodes: int = 0
    kinds: tuple[str, ...] = ()
    resolutions: tuple[str, ...] = ()
    unresolved: bool = False  # whether unresolved edges count
    capped: bool = True  # whether *nodes* holds; without, the nodes of a level share one rank

    def filled(self) -> Options:
        depth = DEPTH_DEFAULT if self.depth <= 0 else min(self.depth, DEPTH_MOST)
        nodes = NODES_DEFAULT if self.nodes <= 0 else min(self.nodes, NODES_MOST)
        nodes = nodes if self.capped else sys.maxsize
        return self._replace(depth=depth, nodes=nodes, direction=self.direction or "both")


def accepted_edges(edges: DataFrame, options: Options) -> DataFrame:
    """The edges that a traversal may use."""
    how = normal_resolution("resolution")
    out = edges
    if options.kinds:
        out = out.where(F.col("kind").isin(*options.kinds))
    if options.resolutions:
        out = out.where(how.isin(*options.resolutions))
    elif not options.unresolved:
        out = out.where(F.coalesce(how, F.lit("")) != "unresolved")
    return out


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next, edge_id): what each node leads to."""
    ahead = edges.select(F.col("from").alias("at"), F.col("to").alias("next"), F.col("id").alias("edge_id"))
    back = edges.select(F.col("to").alias("at"), F.col("from").alias("next"), F.col("id").alias("edge_id"))
    if direction == "outgoing":
        return ahead
    if direction == "incoming":
        return back
    if direction != "both":
        raise ValueError(f"direction {direction!r}")
    return ahead.unionByName(back)


class EdgeIndex(NamedTuple):
    """Edges on disk: as they are, and as moves (at, next, edge_id, kind, resolution, ahead) sorted by *at*."""

    edges: DataFrame
    moves: DataFrame

    @staticmethod
    def build(edges: DataFrame, folder: str, partitions: int = 16) -> EdgeIndex:
        """Write the index of edges (id, kind, from, to, resolution) to a folder, replacing what is there."""
        kept = edges.select("id", "kind", "from", "to", "resolution")
        kept.write.mode("overwrite").parquet(f"{folder}/edges")
        stored = edges.sparkSession.read.schema(kept.schema).parquet(f"{folder}/edges")
        one = lambda at, to, ahead: stored.select(F.col(at).alias("at"), F.col(to).alias("next"), F.col("id").alias("edge_id"), "kind", "resolution", F.lit(ahead).alias("ahead"))
        both = one("from", "to", True).unionByName(one("to", "from", False))
        both.repartitionByRange(partitions, "at", "next").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{folder}/moves")
        return EdgeIndex.load(edges.sparkSession, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> EdgeIndex:
        return EdgeIndex(spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/moves"))


def _moves(edges: DataFrame | EdgeIndex, options: Options) -> DataFrame:
    """(at, next, edge_id) of the edges that a traversal may use."""
    if not isinstance(edges, EdgeIndex):
        return steps(accepted_edges(edges, options), options.direction)
    if options.direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction {options.direction!r}")
    held = accepted_edges(edges.moves, options)
    if options.direction != "both":
        held = held.where(F.col("ahead") == (options.direction == "outgoing"))
    return held.select("at", "next", "edge_id")


class Neighborhood(NamedTuple):
    nodes: DataFrame  # (id, depth, rank): rank is the order of discovery
    edges: DataFrame  # (id, from, to)
    truncated: bool


#: A frontier of so many nodes is looked up by a list of their ids.
LISTED = 1000


def looked_up(moves: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    """moves that begin at the *n* nodes of a frontier (at, ...), with the frontier's columns."""
    if n <= LISTED:
        moves = moves.where(F.col("at").isin([r["at"] for r in frontier.select("at").distinct().collect()]))
    return moves.join(F.broadcast(frontier) if n <= NODES_MOST else frontier, "at")


def _discover(frontier: DataFrame, n: int, moves: DataFrame, visited: DataFrame, seen: int) -> DataFrame:
    """(next, pred, edge_id, prank): for each unseen node its first discoverer; *n* and *seen*: rows of frontier and visited."""
    met = looked_up(moves, frontier.select(F.col("id").alias("at"), F.col("rank").alias("prank")), n)
    first = met.groupBy("next").agg(F.min(F.struct("prank", "edge_id", "at")).alias("m"))
    known = visited.select(F.col("id").alias("next"))
    fresh = first.join(F.broadcast(known) if seen <= NODES_MOST else known, "next", "left_anti")
    return fresh.select("next", F.col("m.at").alias("pred"), F.col("m.edge_id").alias("edge_id"), F.col("m.prank").alias("prank"))


def _ranked(found: DataFrame, base: int, room: int) -> DataFrame:
    """The first *room* discoveries by (rank of the discoverer, id, edge), numbered on from *base*.

    *room* is at most NODES_MOST, so the numbered rows are few however large the level; without
    a cap all rows stay, and share the rank of the last before them.
    """
    if room > NODES_MOST:
        return found.withColumn("rank", F.lit(min(base, 2**31 - 1)))
    top = found.orderBy("prank", "next", "edge_id").limit(room)
    return cut(top.withColumn("rank", F.row_number().over(Window.orderBy("prank", "next", "edge_id")) + F.lit(base)))


def neighborhood(edges: DataFrame | EdgeIndex, seed: str, options: Options = Options()) -> Neighborhood:
    """Nodes within *depth* steps of *seed* in breadth-first order, at most *nodes*, and the edges between them.

    Edges are those of nodes nearer than *depth* whose both ends were visited.
    """
    o = options.filled()
    listed = edges.edges if isinstance(edges, EdgeIndex) else edges
    moves = _moves(edges, o)
    visited = listed.sparkSession.createDataFrame([(seed, 0, 0)], "id string, depth int, rank int")
    frontier, size, count, truncated = visited, 1, 1, False
    for depth in range(1, o.depth + 1):
        found = cut(_discover(frontier, size, moves, visited, count))
        n = found.count()
        if not n:
            break
        room = o.nodes - count
        if n > room:
            truncated = True
        if room <= 0:
            break
        frontier = _ranked(found, count - 1, room).select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "rank")
        visited = visited.unionByName(frontier)
        size = min(n, room)
        count += size
    few = count <= NODES_MOST
    ends = visited.select("id")
    begins = visited.where(F.col("depth") < o.depth).select("id")
    small = lambda df: F.broadcast(df) if few else df
    met = lambda df, c: df.join(small(ends.withColumnRenamed("id", c)), c, "left_semi")
    inside = met(met(accepted_edges(listed, o), "from"), "to")
    # found from the end that a traversal comes from
    near = {"outgoing": ["from"], "incoming": ["to"], "both": ["from", "to"]}[o.direction]
    marked = inside
    for c in near:
        marked = marked.join(small(begins.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))), c, "left")
    kept = marked.where(F.coalesce(*[f"_{c}" for c in near])).select("id", "from", "to")
    return Neighborhood(visited, kept, truncated)


def impact(edges: DataFrame | EdgeIndex, seed: str, options: Options = Options(direction="incoming")) -> Neighborhood:
    """Who depends on the seed: the incoming neighbourhood without the seed itself."""
    n = neighborhood(edges, seed, options)
    return n._replace(nodes=n.nodes.where(F.col("id") != seed))


class Path(NamedTuple):
    found: bool
    nodes: list[str]
    edges: list[str]
    visited: int
    truncated: bool


def shortest_path(edges: DataFrame | EdgeIndex, source: str, target: str, options: Options = Options()) -> Path:
    """A shortest path; among equally short ones that of the first discoverers by (order, id, edge)."""
    o = options.filled()
    if source == target:
        return Path(True, [source], [], 1, False)
    moves = _moves(edges, o)
    visited = moves.sparkSession.createDataFrame([(source, None, None, 0)], "id string, pred string, edge_id string, rank int")
    frontier, size, count = visited, 1, 1
    for _ in range(o.depth):
        found = cut(_discover(frontier, size, moves, visited, count))
        n = found.count()
        room = o.nodes - count
        if not n or room <= 0:
            return Path(False, [], [], count, n > 0)
        frontier = _ranked(found, count - 1, room).select(F.col("next").alias("id"), "pred", "edge_id", "rank")
        visited = visited.unionByName(frontier)
        size = min(n, room)
        count += size
        if frontier.where(F.col("id") == target).take(1):
            nodes, used, at = [target], [], target
            while at != source:  # at most *depth* look-ups
                row = visited.where(F.col("id") == at).first()
                used.append(row.edge_id)
                nodes.append(row.pred)
                at = row.pred
            return Path(True, nodes[::-1], used[::-1], count, False)
        if n > room:
            return Path(False, [], [], count, True)
    return Path(False, [], [], count, False)


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of a graph that fits one task, without recursion."""
    out: dict[str, list[str]] = {}
    for a, b in zip(pdf["from"], pdf["to"], strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    rows: list[tuple[str, str, int]] = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            at, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(out[b])))
                    break
                if b in on:
                    low[at] = min(low[at], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while True:
                        b = stack.pop()
                        on.discard(b)
                        members.append(b)
                        if b == at:
                            break
                    first = min(members)
                    rows += [(b, first, len(members)) for b in members]
    return pd.DataFrame(rows, columns=["id", "component", "size"])


def strongly_connected(edges: DataFrame, kinds: tuple[str, ...] = (), small_edges: int = 200_000, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component, size, cyclic): components by their least member; cyclic with more members than one or a loop.

    Vertices without a way in or out are split off first, round by round; what
    is left is solved in one task if it has at most *small_edges* edges, else by
    colouring: each vertex takes the least label that reaches it, and from the
    vertex of that label its component is found backwards; repeat without it.
    Unresolved edges count.  *nodes* adds vertices without edges.
    """
    used = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    pairs = used.where(F.col("from").isNotNull() & F.col("to").isNotNull()).select("from", "to").distinct()
    pairs = cut(pairs)
    loops = pairs.where(F.col("from") == F.col("to")).select(F.col("from").alias("id"), F.lit(True).alias("loop"))
    everyone = pairs.select(F.col("from").alias("id")).unionByName(pairs.select(F.col("to").alias("id")))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("id"))
    everyone = cut(everyone.distinct())
    core = pairs.where(F.col("from") != F.col("to"))
    n = core.count()
    while n:  # trim
        starts, ends = core.select(F.col("from").alias("v")).distinct(), core.select(F.col("to").alias("v")).distinct()
        both = starts.join(ends, "v", "left_semi")
        core = cut(core.join(both.withColumnRenamed("v", "from"), "from", "left_semi").join(both.withColumnRenamed("v", "to"), "to", "left_semi"))
        m = core.count()
        if m > 0.9 * n:
            n = m
            break
        n = m
    done = None
    while n > small_edges:
        colour = cut(core.select(F.col("from").alias("id")).unionByName(core.select(F.col("to").alias("id"))).distinct().withColumn("c", F.col("id")))
        while True:  # the least label that reaches each vertex
            sent = core.join(colour.withColumnRenamed("id", "from"), "from").select(F.col("to").alias("id"), "c")
            fresh = cut(colour.unionByName(sent).groupBy("id").agg(F.min("c").alias("c")))
            changed = fresh.join(colour, (fresh["id"] == colour["id"]) & (fresh["c"] == colour["c"]), "left_anti").take(1)
            colour = fresh
            if not changed:
                break
        same = cut(
            core.join(colour.select(F.col("id").alias("from"), F.col("c").alias("c1")), "from")
            .join(colour.select(F.col("id").alias("to"), F.col("c").alias("c2")), "to")
            .where(F.col("c1") == F.col("c2"))
            .select("from", "to", F.col("c1").alias("c"))
        )
        reached = cut(colour.where(F.col("id") == F.col("c")))
        frontier = reached
        while True:  # backwards within a colour
            back = same.join(frontier.select(F.col("id").alias("to"), "c"), ["to", "c"]).select(F.col("from").alias("id"), "c").distinct()
            frontier = cut(back.join(reached, ["id", "c"], "left_anti"))
            if not frontier.take(1):
                break
            reached = cut(reached.unionByName(frontier))
        part = reached.select("id", F.col("c").alias("component"))
        done = part if done is None else cut(done.unionByName(part))
        gone = reached.select("id")
        core = cut(core.join(gone.withColumnRenamed("id", "from"), "from", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti"))
        n = core.count()
    rest = core.groupBy(F.lit(0).alias("_all")).applyInPandas(_tarjan, "id string, component string, size bigint").select("id", "component")
    named = rest if done is None else done.unionByName(rest)
    full = everyone.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    # colouring names a component by the label of its colour, which is its least member
    size = full.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return full.join(size, "component").join(loops, "id", "left").select("id", F.col("first").alias("component"), "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of each node."""
    outs = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n_out"))
    ins = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n_in"))
    return nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["n_in", "n_out"]).select("id", "n_in", "n_out")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among the ids."""
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "from"), "from", "left_semi").join(one.withColumnRenamed("id", "to"), "to", "left_semi")


def has_cycle(parents: dict[str, list[str]]) -> bool:
    """Whether a plan of stages (name: needed stages) goes round; plans are small and on the driver."""
    left = {k: set(v) for k, v in parents.items()}
    while left:
        free = [k for k, v in left.items() if not v & left.keys()]
        if not free:
            return True
        for k in free:
            del left[k]
    return False


def waves(parents: dict[str, list[str]]) -> list[list[str]]:
    """Stages in ready waves, each sorted; a ValueError for unknown stages and cycles."""
    unknown = {n for v in parents.values() for n in v} - parents.keys()
    if unknown or has_cycle(parents):
        raise ValueError(f"unknown stages {sorted(unknown)}" if unknown else "cycle")
    done: set[str] = set()
    out = []
    while len(done) < len(parents):
        ready = sorted(k for k, v in parents.items() if k not in done and set(v) <= done)
        out.append(ready)
        done.update(ready)
    return out

"""Parent links to full hierarchies, by fragment contraction.

``hierarchy`` takes (id, parent) rows and returns for each id its root, depth,
number of descendants, path and cycle status.

1. Rows are range-partitioned by a locality column into fragments of at most
   ``fragment_rows`` rows on average.  Inside a fragment every chain of parents is followed with
   numpy to its *exit*: the topmost local ancestor and the distance to it.
2. Fragment tops whose parent lies in another fragment form the quotient
   forest, with edge lengths and weights (rows below a top in its fragment).
   Its leaves are folded into their parents at once, so a star leaves nothing
   of itself, and the rest is solved by the same function.  Where a quotient
   hardly shrinks, as locality is bad, coins choose who is laid beside its
   parent next time, so that a part of every chain is contracted in each round.
3. What the quotient tells of a fragment's tops, and the weights that hang
   below its rows, are sent to the fragment, which expands its chains once
   more: depths and paths add the top's, descendant counts the weights.

Only the rows' ids and parents are moved: once into fragments and once to meet
what is sent to them.  A cycle inside a fragment is found in step 1; a cycle
through several fragments shows up as a cycle of the quotient, and step 3 marks
the rows between the place where the preceding fragment of that cycle enters
and the top.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Status of a row.
FINE, ON_CYCLE, INTO_CYCLE = 0, 1, 2
#: As FINE, but the chain leaves the fragment above its top.
LEAVES = 3

#: So many fragment tops are broadcast to the rows that hold their parents; more meet them in a shuffle.
MOST_TOPS = 100_000
_DONE = "id string, root string, depth bigint, size bigint, status int, path array<string>"


def _follow(pos: np.ndarray, elen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(top, distance, hops, state) of each row; pos: the parent's place or -1."""
    n = len(pos)
    here = np.arange(n)
    top_row = pos < 0
    jump = np.where(top_row, here, pos)
    dist = np.where(top_row, 0, elen).astype(np.int64)
    hops = np.where(top_row, 0, 1).astype(np.int64)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        dist = dist + dist[jump]
        hops = hops + hops[jump]
        jump = jump[jump]
    state = np.where(top_row[jump], FINE, INTO_CYCLE)
    state[np.unique(jump[state == INTO_CYCLE])] = ON_CYCLE
    return jump, dist, hops, state


def _positions(ids: pd.Series, parents: pd.Series) -> np.ndarray:
    # get_indexer would match a null parent with nothing, as ids are never null
    return pd.Index(ids).get_indexer(parents.where(parents.notna(), other="\x00none"))


def _sums(pos: np.ndarray, hops: np.ndarray, state: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = start.astype(np.int64).tolist()
    parent, ok = pos.tolist(), (state == FINE).tolist()
    for i in np.argsort(-hops, kind="stable").tolist():
        if ok[i] and parent[i] >= 0:
            total[parent[i]] += total[i]
    return np.array(total, dtype=np.int64)


def _marks(pos: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A row and all rows above it, from each marked row."""
    out, parent = np.zeros(len(pos), dtype=bool), pos.tolist()
    for i in np.flatnonzero(mark).tolist():
        while i >= 0 and not out[i]:
            out[i] = True
            i = parent[i]
    return out


def _chains(pos: np.ndarray, hops: np.ndarray, state: np.ndarray, labels: list) -> list:
    chain: list = [None] * len(pos)
    for i in np.argsort(hops, kind="stable").tolist():
        if state[i] == FINE:
            own = list(labels[i]) if labels[i] is not None else []
            chain[i] = own if pos[i] < 0 else chain[pos[i]] + own
    return chain


def _solve_one(with_paths: bool):
    """A whole forest that fits one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = _positions(pdf["id"], pdf["parent"])
        top, dist, hops, state = _follow(pos, pdf["elen"].to_numpy())
        size = _sums(pos, hops, state, pdf["weight"].to_numpy())
        ids = pdf["id"].to_numpy()
        fine = state == FINE
        path = _chains(pos, hops, state, pdf["label"].tolist()) if with_paths else [None] * len(pos)
        return pd.DataFrame(
            {"id": ids, "root": np.where(fine, ids[top], None), "depth": np.where(fine, dist, -1), "size": size, "status": state.astype(np.int32), "path": path}
        )

    return run


_CONTRACTED = "id string, frag int, parent string, elen bigint, label array<string>, top string, dist bigint, state int, below bigint, top_below bigint, chain array<string>"


def _local(pdf: pd.DataFrame, with_paths: bool):
    """(positions, tops, distances, hops, states, chains) of a fragment."""
    pos = _positions(pdf["id"], pdf["parent"])
    top, dist, hops, state = _follow(pos, pdf["elen"].to_numpy())
    leaves = (state == FINE) & pdf["parent"].notna().to_numpy()[top]
    chain = _chains(pos, hops, state, pdf["label"].tolist()) if with_paths else [None] * len(pos)
    return pos, top, dist, hops, np.where(leaves, LEAVES, state).astype(np.int32), chain


def _contract(with_paths: bool):
    """Each partition is a fragment."""

    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        pos, top, dist, hops, state, chain = _local(pdf, with_paths)
        below = _sums(pos, hops, np.where(state == LEAVES, FINE, state), pdf["weight"].to_numpy())
        ids = pdf["id"].to_numpy()
        yield pd.DataFrame(
            {"id": ids, "frag": pdf["frag"], "parent": pdf["parent"], "elen": pdf["elen"], "label": pdf["label"], "top": ids[top], "dist": dist, "state": state, "below": below, "top_below": below[top], "chain": chain}
        )

    return run


_MESSAGE = "frag int, id string, told boolean, q_root string, q_depth bigint, q_status int, q_path array<string>, hang bigint, enters int"


def _expand(with_paths: bool):
    def run(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        pos, top, dist, hops, state, chain = _local(pdf, with_paths)
        ids = pdf["id"].to_numpy()
        hanging, enters = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        root, depth, quotient = ids[top], np.zeros(n, dtype=np.int64), np.full(n, FINE, dtype=np.int64)
        above: list = [None] * n
        if len(sent):
            at = pd.Index(pdf["id"]).get_indexer(sent["id"])
            told = sent["told"].to_numpy(dtype=bool)
            hung = ~told
            hanging[at[hung]] = sent["hang"].to_numpy()[hung].astype(np.int64)
            enters[at[hung]] = sent["enters"].to_numpy()[hung] > 0
            of_top = {a: k for a, k in zip(at[told].tolist(), np.flatnonzero(told).tolist(), strict=True)}
            row = np.array([of_top.get(t, -1) for t in top.tolist()])
            known = row >= 0
            q_root, q_depth, q_status = sent["q_root"].to_numpy(), sent["q_depth"].fillna(0).to_numpy(dtype=np.int64), sent["q_status"].fillna(FINE).to_numpy(dtype=np.int64)
            root = np.where(known, q_root[row], root)
            depth[known], quotient[known] = q_depth[row[known]], q_status[row[known]]
            if with_paths:
                paths = sent["q_path"].tolist()
                above = [paths[k] if k >= 0 else None for k in row.tolist()]
        size = _sums(pos, hops, np.where(state == LEAVES, FINE, state), pdf["weight"].to_numpy() + hanging)
        status = np.where(state == LEAVES, quotient, state)
        # in a fragment on a global cycle only the rows above an entry are on it
        marked = _marks(pos, enters)
        status = np.where((state == LEAVES) & (quotient == ON_CYCLE), np.where(marked, ON_CYCLE, INTO_CYCLE), status)
        fine = status == FINE
        path = [(list(q) if q is not None else []) + list(c) if f and c is not None else None for q, c, f in zip(above, chain, fine, strict=True)] if with_paths else [None] * n
        return pd.DataFrame({"id": ids, "root": np.where(fine, root, None), "depth": np.where(fine, dist + depth, -1), "size": size, "status": status.astype(np.int32), "path": path})

    return run


def _leader(level: int) -> Column:
    """The id beside which a row is laid: its parent's where coins fall so, else its own."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2))
    beside = F.col("parent").isNotNull() & (coin(F.col("id")) == 0) & (coin(F.col("parent")) == 1)
    return F.md5(F.when(beside, F.col("parent")).otherwise(F.col("id")))


def _quotient(links: DataFrame, n: int, fragment_rows: int, with_paths: bool, level: int, most_tops: int) -> DataFrame:
    """(id, root, depth, size, status, path) of all linked tops."""
    met = cut(links.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.max(F.when(F.col("x_state") == FINE, F.col("x_below"))).alias("base")))
    leaf = cut(links.join(met.select("id", F.lit(True).alias("inner")), "id", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    folded = leaf.where(~F.col("inner") & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.sum("weight").alias("folded"))
    none = F.array().cast("array<string>")
    forest = leaf.where("inner").select("id", "parent", "elen", "weight", "loc", "label").unionByName(
        met.where(F.col("base").isNotNull()).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("elen"), F.col("base").alias("weight"), F.lit("").alias("loc"), none.alias("label"))
    )
    forest = cut(forest.join(folded, "id", "left").withColumn("weight", F.col("weight") + F.coalesce("folded", F.lit(0))).drop("folded"))
    m = forest.count()
    if m > n / 2:
        forest = forest.withColumn("loc", _leader(level))
    solved = cut(_solve(forest, m, fragment_rows, with_paths, level + 1, most_tops))
    # a fold hangs below a row of the forest, or is a root itself
    over = solved.select(F.col("id").alias("p_id"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("status").alias("p_status"), F.col("path").alias("p_path"))
    folds = leaf.where(~F.col("inner")).join(F.broadcast(over) if m <= most_tops else over, F.col("parent") == F.col("p_id"), "left")
    fine = F.coalesce("p_status", F.lit(FINE)) == FINE
    ends = folds.select(
        "id",
        F.when(F.col("p_id").isNull(), F.col("id")).otherwise(F.col("p_root")).alias("root"),
        F.when(F.col("p_id").isNull(), 0).when(fine, F.col("p_depth") + F.col("elen")).otherwise(-1).cast("bigint").alias("depth"),
        F.col("weight").alias("size"),
        F.when(fine, FINE).otherwise(INTO_CYCLE).cast("int").alias("status"),
        (F.when(fine, F.concat(F.coalesce("p_path", none), F.coalesce("label", none))) if with_paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    return cut(solved.unionByName(ends))


def _solve(nodes: DataFrame, n: int, fragment_rows: int, with_paths: bool, level: int, most_tops: int) -> DataFrame:
    """nodes: (id, parent, elen, weight, loc, label), with unique ids; a parent that is no id makes a root."""
    if n <= fragment_rows:
        return nodes.groupBy(F.lit(0).alias("_all")).applyInPandas(_solve_one(with_paths), _DONE)
    parts = math.ceil(n / fragment_rows)
    placed = cut(nodes.repartitionByRange(parts, "loc", "id").drop("loc").withColumn("frag", F.spark_partition_id()))
    local = placed.mapInPandas(_contract(with_paths), _CONTRACTED)
    tops = cut(local.where((F.col("state") == LEAVES) & (F.col("id") == F.col("top"))).select("id", "parent", "elen", F.col("below").alias("weight"), "label", "frag"))
    few = tops.limit(most_tops + 1).count() <= most_tops
    seen = local.select(F.col("id").alias("x_id"), F.col("top").alias("x_top"), F.col("dist").alias("x_dist"), F.col("state").alias("x_state"), F.col("top_below").alias("x_below"), F.col("chain").alias("x_chain"), F.col("frag").alias("x_frag"))
    small = lambda df: F.broadcast(df) if few else df
    found = cut(seen.join(small(tops.select(F.col("parent").alias("x_id")).distinct()), "x_id", "left_semi"))
    leads = F.col("x_state").isin(FINE, LEAVES)
    none = F.array().cast("array<string>")
    links = cut(
        tops.join(small(found), F.col("parent") == F.col("x_id"), "left").select(
            "id",
            "frag",
            "x_id",
            "x_frag",
            "x_state",
            "x_below",
            F.when(leads, F.col("x_top")).alias("parent"),
            (F.col("elen") + F.coalesce("x_dist", F.lit(0))).alias("elen"),
            "weight",
            F.format_string("%010d", F.coalesce("x_frag", "frag")).alias("loc"),
            (F.concat(F.when(leads, F.coalesce("x_chain", none)).otherwise(none)) if with_paths else none).alias("label"),
            (F.col("x_id").isNotNull() & ~leads).alias("bad"),
        )
    )
    messages = placed.sparkSession.createDataFrame([], _MESSAGE)
    if links.take(1):
        solved = _quotient(links, n, fragment_rows, with_paths, level, most_tops)
        # below a top that ends in a local cycle everything leads into that cycle
        bad = links.where("bad").select(F.col("id").alias("root"), F.lit(1).alias("doomed"))
        told = links.select("id", "frag").join(solved, "id").join(small(bad), "root", "left")
        messages = told.select("frag", "id", F.lit(True).alias("told"), F.col("root").alias("q_root"), F.col("depth").alias("q_depth"), F.when(F.col("doomed") == 1, INTO_CYCLE).otherwise(F.col("status")).cast("int").alias("q_status"), F.col("path").alias("q_path"), F.lit(0).cast("bigint").alias("hang"), F.lit(0).alias("enters")).unionByName(
            links.where(F.col("parent").isNotNull())
            .select("id", "x_id", "x_frag")
            .join(solved.select("id", "size", "status"), "id")
            .groupBy(F.col("x_frag").alias("frag"), F.col("x_id").alias("id"))
            .agg(F.sum("size").alias("hang"), F.max(F.when(F.col("status") == ON_CYCLE, 1).otherwise(0)).alias("enters"))
            .select("frag", "id", F.lit(False).alias("told"), F.lit(None).cast("string").alias("q_root"), F.lit(0).cast("bigint").alias("q_depth"), F.lit(FINE).alias("q_status"), F.lit(None).cast("array<string>").alias("q_path"), "hang", "enters")
        )
    return placed.groupBy("frag").cogroup(messages.groupBy("frag")).applyInPandas(_expand(with_paths), _DONE)


def hierarchy(
    df: DataFrame,
    id_col: str | Column = "id",
    parent_col: str | Column = "parent",
    locality: str | Column | None = None,
    fragment_rows: int = 50_000,
    with_paths: bool = False,
    unique: bool = False,
    most_tops: int = MOST_TOPS,
) -> DataFrame:
    """Root, depth, descendants, path and cycle status of every id.

    Returns (id, root, depth, n_descendants, status, path).  status: 0 fine,
    1 on a cycle, 2 leading into one; for 1 and 2 root and path are null and
    depth and n_descendants are -1.  A root has depth 0.  path runs from the
    root to the id itself and is null unless *with_paths*.

    Rows without an id are left out; a null parent, or one that is no id, makes
    a root.  Repeats of a row count once; of rows of one id with several parents
    the greatest parent counts (deduplicate before, if another should).  An empty input
    gives no rows.  Other columns are ignored.

    *locality*: a column by which children lie near their parents (ids, times);
    it only affects speed.  *fragment_rows* bounds what one task holds.  *unique*
    tells that ids are distinct and not null already.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    loc = F.lit("") if locality is None else as_col(locality).cast("string")
    rows = df.select(as_col(id_col).alias("id"), as_col(parent_col).alias("parent"), F.coalesce(loc, F.lit("")).alias("loc"))
    if not unique:
        rows = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("parent", "loc")).alias("r")).select("id", "r.parent", "r.loc")
    one = F.lit(1).cast("bigint")
    nodes = cut(rows.select("id", "parent", one.alias("elen"), one.alias("weight"), "loc", (F.array("id") if with_paths else F.lit(None).cast("array<string>")).alias("label")))
    done = _solve(nodes, nodes.count(), fragment_rows, with_paths, 0, most_tops)
    fine = F.col("status") == FINE
    return done.select("id", "root", "depth", F.when(fine, F.col("size") - 1).otherwise(-1).alias("n_descendants"), "status", "path")


def descendants(paths: DataFrame) -> DataFrame:
    """(id, descendant, distance) rows from the paths of ``hierarchy``.

    One row for each pair of a row and a row below it; rows on or above cycles
    have no path and no pairs.
    """
    return (
        paths.where(F.col("path").isNotNull())
        .select(F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "id"))
        .where(F.col("at") < F.col("n") - 1)
        .select("id", "descendant", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance"))
    )


def intervals(tree: DataFrame, fragment_rows: int = 50_000) -> DataFrame:
    """(id, root, first, last) of rows with a path: an id's descendants are the ids of the same root with a greater *first* up to its *last*.

    The compact form of all pairs: as many rows as ids.  *first* is the place of
    an id among the ids of its root in the order of their paths, *last* that of
    its last descendant.  tree: the result of ``hierarchy`` with paths.
    """
    fine = tree.where(F.col("path").isNotNull()).select("id", "root", F.col("n_descendants"), F.array_join("path", "\x00").alias("way"))
    parts = max(1, math.ceil(fine.count() / fragment_rows))
    # numbered without a sort in one task: by ranges, with the sizes of the ranges before
    ranged = cut(fine.repartitionByRange(parts, "root", "way").sortWithinPartitions("root", "way").select("id", "root", "n_descendants", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")))
    inside = ranged.withColumn("n", F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = inside.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # as many rows as ranges
    numbered = inside.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("n"))
    starts = numbered.groupBy("root").agg(F.min("place").alias("start"))
    return numbered.join(starts, "root").select("id", "root", (F.col("place") - F.col("start")).alias("first"), (F.col("place") - F.col("start") + F.col("n_descendants")).alias("last"))

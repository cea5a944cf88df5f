"""Root-to-leaf paths: listed up to a cap, and counted as a set over many conversations.

Order of paths: roots from the smallest position, at each message the children from the largest.
The k-th path follows from counts alone: each edge knows how many paths begin earlier below its
parent, so one walk finds a path, and edges whose paths all lie beyond the cap are never needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from threadloom.operators.graph import by_size, components, forest, keyed_schema, path_counts, valid_edges
from threadloom.operators.ordered import running_sum
from threadloom.schema import CONV, PATH_CAP
from threadloom.session import materialize


def leaf_ways(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = tuple(CONV), limit: int | None = None) -> DataFrame:
    """(keys, pos, ways): number of paths from a message down to leaves, as DOUBLE.

    Counting upwards is counting downwards in the mirrored conversation.
    """
    last = F.lit(2**40)
    turned = edges.select(*keys, (last - F.col("parent")).alias("child"), (last - F.col("child")).alias("parent"))
    got = path_counts(nodes.select(*keys, (last - F.col("pos")).alias("pos")), turned, keys, limit=limit)
    return got.select(*keys, (last - F.col("pos")).alias("pos"), F.col("n_paths").alias("ways"))


def path_steps(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = tuple(CONV), limit: int | None = None) -> DataFrame:
    """(keys, node, child, before, ways): the edges, and a step from node -1 to every root.

    ``ways``: paths through this step seen from ``node``; ``before``: paths of its siblings that come first.
    """
    keys = list(keys)
    ways = materialize(leaf_ways(nodes, edges, keys, limit), "ways")
    roots = nodes.select(*keys, "pos").join(edges.select(*keys, F.col("child").alias("pos")), [*keys, "pos"], "left_anti")
    steps = edges.select(*keys, F.col("parent").alias("node"), "child", (-F.col("child")).alias("_rank"))
    steps = steps.unionByName(roots.select(*keys, F.lit(-1).cast("long").alias("node"), F.col("pos").alias("child"), F.col("pos").alias("_rank")))
    steps = materialize(steps.join(ways.withColumnRenamed("pos", "child"), [*keys, "child"]), "steps")
    return running_sum(steps, [*keys, "node"], ["_rank"], F.col("ways"), "before").select(*keys, "node", "child", F.col("before").cast("double").alias("before"), "ways")


class FirstPaths:
    """Table function: the first paths of one conversation from its steps ordered by (node, before).

    Parents come before their children, so when the steps of a message arrive, the number of its
    first path is known.  Only steps that lie on the first ``cap`` paths are kept: at most ``cap``
    times the longest path, however many paths or steps there are.
    """

    def __init__(self) -> None:
        self.name = None
        self.first = {-1: 0.0}
        self.steps: dict[int, list[tuple[float, float, int]]] = {}
        self.total = 0.0

    def eval(self, step: Row, cap: int) -> None:
        self.cap, self.name = cap, step.conv_id
        if step.node == -1:
            self.total += step.ways
        begin = self.first.get(step.node, float("inf")) + step.before
        if begin < cap:
            self.steps.setdefault(step.node, []).append((step.before, step.ways, step.child))
            self.first[step.child] = min(begin, self.first.get(step.child, begin))

    def terminate(self):
        for rank in range(int(min(self.total, self.cap))):
            left, node, path = float(rank), -1, []
            while node in self.steps:
                before, _, node = next(s for s in self.steps[node] if s[0] <= left < s[0] + s[1])
                left -= before
                path.append(node)
            yield self.name, rank, path, self.total, self.total >= self.cap


PATHS = "conv_id string, rank long, path array<long>, n_paths double, truncated boolean"


def register_paths(spark: SparkSession, name: str = "first_paths") -> None:
    """Make the table function known to SQL: ``first_paths(TABLE(steps) PARTITION BY (...) ORDER BY (node, before), cap)``."""
    spark.udtf.register(name, udtf(FirstPaths, returnType=PATHS))


def first_paths(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = tuple(CONV), cap: int = PATH_CAP, limit: int | None = None) -> DataFrame:
    """(keys, rank, path, n_paths, truncated): the first ``cap`` paths of every conversation, from rank 0.

    ``n_paths`` counts all of them (DOUBLE, exact below 2^53); ``truncated`` says that ``cap`` was reached.
    Steps that no path below the cap can take are dropped before they travel.
    """
    keys = list(keys)
    good = valid_edges(edges, keys)
    steps = path_steps(nodes, good, keys, limit).where((F.col("before") < cap) | (F.col("node") == -1))

    class Keyed(FirstPaths):
        def eval(self, step: Row, cap: int) -> None:
            self.key = tuple(step[k] for k in keys)
            super().eval(step, cap)

        def terminate(self):
            for row in super().terminate():
                yield (*self.key, *row[1:])

    listed = udtf(Keyed, returnType=keyed_schema(steps, keys, PATHS.removeprefix("conv_id string, ")))
    return listed(steps.asTable().partitionBy(*keys).orderBy("node", "before"), F.lit(cap))


# ---------------------------------------------------------------- sets of paths over many conversations


#: Sums that tell sets apart: of three numbers of 36 bits each, so 2^27 members cannot overflow a BIGINT.
LANES, BITS = 3, 36
H = [f"h{k}" for k in range(LANES)]


def _hashes(*cols) -> list:
    return [F.shiftright(F.xxhash64(F.lit(k), *cols), 64 - BITS) for k in range(LANES)]


def _sums(*cols) -> list:
    return [F.sum(h).alias(f"h{k}") for k, h in enumerate(_hashes(*cols))]


def climb_sums(edges: DataFrame, values: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Sums of ``cols`` over a message and all above it, where every message has one parent at most.

    Pointer doubling: the number of rounds is the logarithm of the longest chain.
    """
    keys = list(keys)
    values, edges = values.select(*keys, "pos", *cols), edges.select(*keys, "child", "parent")

    def local(values: DataFrame, edges: DataFrame) -> DataFrame:
        def climb(held: pd.DataFrame, jump: pd.DataFrame) -> pd.DataFrame:
            child, parent = jump["child"].to_numpy(), jump["parent"].to_numpy()
            pos = np.unique(np.concatenate([held["pos"].to_numpy(), child, parent]))
            at, up = np.searchsorted(pos, held["pos"].to_numpy()), np.full(len(pos), -1)
            up[np.searchsorted(pos, child)] = np.searchsorted(pos, parent)
            sums = np.zeros((len(cols), len(pos)), dtype=np.int64)
            sums[:, at] = held[list(cols)].to_numpy(dtype=np.int64).T
            while (live := np.flatnonzero(up >= 0)).size:
                sums[:, live] += sums[:, up[live]]
                up[live] = up[up[live]]
            return held.assign(**{c: sums[k, at] for k, c in enumerate(cols)})

        both = values.groupBy(*keys).cogroup(edges.groupBy(*keys))
        return both.applyInPandas(climb, keyed_schema(values, keys, "pos long, " + ", ".join(f"{c} long" for c in cols)))

    return by_size(values, [edges], keys, limit, local, lambda v, e: _spread_sums(e, v, keys, cols))


def _spread_sums(edges: DataFrame, values: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    held = materialize(values, "sums")
    cur = materialize(edges.select(*keys, F.col("child").alias("pos"), F.col("parent").alias("up")), "jump")
    while not cur.isEmpty():
        above = held.select(*keys, F.col("pos").alias("up"), *[F.col(c).alias(f"_{c}") for c in cols])
        got = cur.join(above, [*keys, "up"]).select(*keys, "pos", *[f"_{c}" for c in cols])
        held = held.join(got, [*keys, "pos"], "left").select(*keys, "pos", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in cols])
        held = materialize(held, "sums")
        on = cur.select(*keys, F.col("pos").alias("up"), F.col("up").alias("up2"))
        cur = materialize(cur.join(on, [*keys, "up"]).select(*keys, "pos", F.col("up2").alias("up")), "jump")
    return held


def distinct_paths(nodes: DataFrame, edges: DataFrame, by: Sequence[str], keys: Sequence[str] = tuple(CONV), limit: int | None = None) -> DataFrame:
    """(by, n_paths): distinct paths, as tuples of positions, over all conversations of a group ``by``.

    ``keys`` name a conversation and contain ``by``.  No path is listed.  Graphs with the same messages and edges count once.  Where
    all above a message have one parent, its path is one tuple, told by the sum of its positions'
    hashes (positions rise along a path, so the set gives the tuple); leaves there are counted by
    distinct sums.  Beyond, where a message has several parents, a deterministic automaton goes on: its
    states are the conversations that share the tuple so far.  A state of one conversation ends with that
    conversation's own count of paths; only states that several conversations share take steps.
    """
    by, keys = list(by), list(keys)
    nodes, edges = _one_of_each(nodes, edges, by, keys)
    ways = leaf_ways(nodes, edges, keys, limit)
    info = forest(nodes, edges, keys).select(*keys, "pos", "n_parents", "is_leaf").join(ways, [*keys, "pos"])
    info = materialize(info.withColumns(dict(zip(H, _hashes("pos"), strict=True))), "info")
    # single-parent pointers; a message is in the tree part if no junction lies on its way up
    single = edges.join(info.where("n_parents = 1").select(*keys, F.col("pos").alias("child")), [*keys, "child"], "left_semi")
    junction = (F.col("n_parents") > 1).cast("long")
    sums = climb_sums(single, info.select(*keys, "pos", *H, junction.alias("j"), F.lit(1).cast("long").alias("depth")), keys, [*H, "j", "depth"], limit)
    sums = materialize(sums, "sums")
    tree = sums.where("j = 0").drop("j")
    path = [*by, "depth", *H, "pos"]
    hop = edges.join(info.where("n_parents > 1").select(*keys, F.col("pos").alias("child")), [*keys, "child"], "left_semi").withColumnRenamed("parent", "pos")
    entry = tree.join(hop, [*keys, "pos"]).select(*keys, F.col("pos").alias("via"), F.col("child").alias("pos"), (F.col("depth") + 1).alias("depth"), *[(F.col(f"h{k}") + h).alias(f"h{k}") for k, h in enumerate(_hashes("child"))])
    entry = materialize(entry, "entries")
    # what follows a shared entry is left to the automaton, also in conversations where it is a tree
    marked = tree.join(entry.select(*path).distinct().withColumn("_on", F.lit(1).cast("long")), path, "left").select(*keys, "pos", *path[len(by) : -1], F.coalesce("_on", F.lit(0)).alias("on"))
    marked = materialize(marked, "marked")
    inside = single.join(marked.select(*keys, F.col("pos").alias("child")), [*keys, "child"], "left_semi")
    over = materialize(marked.join(climb_sums(inside, marked, keys, ["on"], limit).withColumnRenamed("on", "over"), [*keys, "pos"]), "over")
    plain = over.where("over = 0").join(info.where("is_leaf").select(*keys, "pos"), [*keys, "pos"], "left_semi")
    out = plain.select(*path).distinct().groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    tops = over.where("over = 1 and on = 1").select(*keys, *path[len(by) :])
    free = entry.join(over.where("over = 0").select(*keys, F.col("pos").alias("via")), [*keys, "via"], "left_semi").select(*keys, *path[len(by) :])
    state = [*by, "depth", *H, "n_in", "pos"]
    start = tops.unionByName(free).distinct().withColumn("n_in", F.lit(0).cast("long"))
    members = materialize(start.withColumn("paths", F.lit(1.0)), "states")
    graph = F.struct(*keys)
    while not members.isEmpty():
        known = members.join(info.select(*keys, "pos", "is_leaf", "ways"), [*keys, "pos"])
        size = known.groupBy(*state).agg(F.count("*").alias("many"), F.max("is_leaf").alias("stops"), F.max("ways").alias("ways"), F.max("paths").alias("paths"))
        size = materialize(size, "sizes")
        done = size.select(*by, F.when(F.col("many") == 1, F.col("ways")).otherwise(F.col("stops").cast("double")).alias("w"), "paths")
        out = out.unionByName(done.groupBy(*by).agg(F.sum(F.col("w") * F.col("paths")).alias("n")))
        shared = members.join(size.where("many > 1").select(*state), state, "left_semi")
        moved = shared.join(edges.withColumnRenamed("parent", "pos"), [*keys, "pos"]).withColumnRenamed("child", "to")
        # states with the same conversations at the same message are one: their counts add up
        source = F.struct(*[c for c in state if c not in by])
        who = moved.select(*keys, "to", source.alias("_from"), "paths")
        sets = who.groupBy(*by, "_from", "to").agg(*_sums(graph), F.count("*").alias("n_in"), F.max("paths").alias("paths"))
        sets = materialize(sets, "sets")
        merged = sets.groupBy(*by, "to", *H, "n_in").agg(F.sum("paths").alias("paths"), F.min("_from").alias("_from"))
        new = merged.join(who.drop("paths"), [*by, "to", "_from"])
        members = materialize(new.select(*keys, F.lit(0).cast("long").alias("depth"), *H, "n_in", F.col("to").alias("pos"), "paths"), "states")
    return materialize(out, "paths").groupBy(*by).agg(F.sum("n").alias("n_paths"))


def _one_of_each(nodes: DataFrame, edges: DataFrame, by: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of conversations with the same messages and edges, one."""
    cells = edges.select(*keys, "child", "parent").unionByName(nodes.select(*keys, F.col("pos").alias("child"), F.lit(-1).cast("long").alias("parent")))
    prints = cells.groupBy(*keys).agg(*_sums("child", "parent"), F.count("*").alias("_n"))
    rest = [k for k in keys if k not in by]
    one = materialize(prints.groupBy(*by, *H, "_n").agg(F.min(F.struct(*rest)).alias("_one")).select(*by, "_one.*"), "graphs")
    return (d.join(one, keys, "left_semi") for d in (nodes.select(*keys, "pos"), edges.select(*keys, "child", "parent")))


def distinct_threads(nodes: DataFrame, edges: DataFrame, by: Sequence[str], keys: Sequence[str] = tuple(CONV), limit: int | None = None) -> DataFrame:
    """(by, n, h0, h1, h2): distinct components, as sets of positions, over all conversations of a group."""
    label = components(nodes, edges, list(keys), limit)
    one = label.groupBy(*keys, "comp").agg(F.count("*").alias("n"), *_sums("pos"))
    return one.select(*by, "n", *H).distinct()

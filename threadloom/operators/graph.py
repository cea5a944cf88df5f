"""Graph operators on edge tables, keyed by conversation.

Conversations of up to ``LOCAL_MSGS`` messages (the size is checked) are solved whole, one grouped
task each and one exchange in all; where a task compares ancestor sets (``LOCAL_SETS``) or lists
pairs (``LOCAL_PAIRS``) the bound is lower.  Larger ones are never gathered: they take joins and
aggregations on (keys, node), where long reply chains are resolved by pointer doubling, so the
number of rounds grows with the logarithm of the longest chain.  Each of those rounds is written
out, which cuts the lineage.  Both ways give the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.schema import CONV
from threadloom.session import by_true_size, materialize

Keys = Sequence[str]

#: Largest conversation that one grouped task may hold: a few numbers a message and edge.
LOCAL_MSGS = 2_000_000
#: The same where the task compares ancestor sets, in time of gold parents x edges / 64 at most.
LOCAL_SETS = 2_000_000
#: The same where the task lists all pairs of a message and an ancestor.
LOCAL_PAIRS = 20_000
#: Ancestors that are looked for at a time, at least.
BITS = 8192
#: Bytes that the masks of all messages with children to come may take together, where that gives more than ``BITS``.
MASK_BYTES = 64_000_000
#: But no more than so many bits.
MASK_BITS = 2**19
#: ``BITS`` in a stretch of positions, where a conversation is shared out over tasks.
BANDS = 16


def by_size(
    nodes: DataFrame,
    tables: Sequence[DataFrame],
    keys: Keys,
    limit: int | None,
    local: Callable[..., DataFrame],
    spread: Callable[..., DataFrame],
) -> DataFrame:
    """Send conversations of up to ``limit`` messages to ``local`` and the others to ``spread``."""
    limit = LOCAL_MSGS if limit is None else limit
    sizes = nodes.groupBy(*keys).count()
    if sizes.where(F.col("count") > limit).isEmpty():
        return local(nodes, *tables)
    big = materialize(sizes.where(F.col("count") > limit).select(*keys), "big")
    by_true_size(nodes.sparkSession)
    pick = lambda how: [d.join(big, list(keys), how) for d in (nodes, *tables)]
    return local(*pick("left_anti")).unionByName(spread(*pick("left_semi")))


def keyed_schema(df: DataFrame, keys: Keys, rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys) + ", " + rest


def solve(pdf: pd.DataFrame) -> tuple[dict, dict, dict]:
    """Component, longest depth and path count of the nodes of one edge list (parent < child).

    Negative parents restrict path starts: -1 marks its child as an allowed one.
    """
    pdf = pdf.sort_values(["child", "parent"])
    free = bool((pdf["parent"] >= 0).all())
    marks = set(pdf.loc[pdf["parent"] == -1, "child"])
    real = pdf[pdf["parent"] >= 0]
    comp: dict[int, int] = {}
    deep: dict[int, int] = {}
    ways: dict[int, float] = {}

    def top(x: int) -> int:
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    for child, parent in zip(real["child"].tolist(), real["parent"].tolist()):
        if parent not in comp:
            comp[parent], deep[parent] = parent, 0
            ways[parent] = 1.0 if free or parent in marks else 0.0
        if child not in comp:
            comp[child], deep[child], ways[child] = child, 0, 0.0
        deep[child] = max(deep[child], deep[parent] + 1)
        ways[child] += ways[parent]
        a, b = top(child), top(parent)
        comp[max(a, b)] = min(a, b)
    return {x: top(x) for x in comp}, deep, ways


def _local_values(edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, pos, comp, depth, n_paths) of every node that has an edge."""
    keys = list(keys)

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        comp, deep, ways = solve(pdf)
        out = pd.DataFrame({"pos": list(comp), "comp": list(comp.values())})
        out["depth"], out["n_paths"] = list(deep.values()), list(ways.values())
        for k, v in zip(keys, key):
            out.insert(0, k, v)
        return out[[*keys, "pos", "comp", "depth", "n_paths"]]

    schema = keyed_schema(edges, keys, "pos long, comp long, depth long, n_paths double")
    return edges.select(*keys, "child", "parent").groupBy(*keys).applyInPandas(each, schema)


def valid_edges(edges: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Distinct edges that point back in time (self links and forward links removed)."""
    return edges.where("parent >= 0 and parent < child").select(*keys, "child", "parent").distinct()


def forest(nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Per node: number of parents and children, root and leaf flags."""
    ups = edges.groupBy(*keys, F.col("child").alias("pos")).agg(F.count("*").alias("n_parents"))
    downs = edges.groupBy(*keys, F.col("parent").alias("pos")).agg(F.count("*").alias("n_children"))
    return (
        nodes.select(*keys, "pos")
        .join(ups, [*keys, "pos"], "left")
        .join(downs, [*keys, "pos"], "left")
        .na.fill(0, ["n_parents", "n_children"])
        .withColumn("is_root", F.col("n_parents") == 0)
        .withColumn("is_leaf", F.col("n_children") == 0)
    )


# ---------------------------------------------------------------- chains of single pointers


def chase(ptr: DataFrame, keys: Keys = tuple(CONV), keep_steps: bool = False):
    """Follow ``node -> up`` pointers to their end: (keys, node, up, hops).

    Doubling: after round k a pointer spans 2^k hops or has reached its end.  With ``keep_steps``
    the tables of all rounds are returned as well (they answer k-th ancestor questions).
    """
    cur = materialize(
        ptr.select(*keys, "node", "up", F.lit(1).cast("long").alias("hops"), F.lit(True).alias("live")), "chase"
    )
    steps = [cur]
    while not cur.where("live").isEmpty():
        onward = cur.select(
            *keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("live").alias("live2")
        )
        moved = (
            cur.where("live")
            .join(onward, [*keys, "up"], "left")
            .select(
                *keys,
                "node",
                F.coalesce("up2", "up").alias("up"),
                (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"),
                F.coalesce("live2", F.lit(False)).alias("live"),
            )
        )
        cur = materialize(cur.where("not live").unionByName(moved), "chase")
        steps.append(cur)
    return (cur.drop("live"), steps) if keep_steps else cur.drop("live")


def contract(nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Give every node its junction: the nearest node upwards with no parent or several parents."""
    single = (
        edges.groupBy(*keys, F.col("child").alias("node"))
        .agg(F.count("*").alias("n"), F.min("parent").alias("up"))
        .where("n = 1")
    )
    ends = chase(single, keys)
    return materialize(
        nodes.select(*keys, F.col("pos").alias("node"))
        .join(ends, [*keys, "node"], "left")
        .select(*keys, "node", F.coalesce("up", "node").alias("rep"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops")),
        "contract",
    )


def _relax(
    nodes: DataFrame, edges: DataFrame, keys: Keys, base: Column, step: Column, combine, start: DataFrame | None = None
) -> DataFrame:
    """Fixed point of ``value(j) = combine over parents p of step(value(rep(p)), hops(p))``.

    Runs on junctions only; one round per level of several-parent junctions.
    """
    reps = contract(nodes, edges, keys)
    multi = edges.groupBy(*keys, "child").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    up = reps.select(*keys, F.col("node").alias("parent"), F.col("rep").alias("via"), F.col("hops").alias("d"))
    joined = materialize(
        edges.join(multi, [*keys, "child"], "left_semi")
        .join(up, [*keys, "parent"])
        .select(*keys, F.col("child").alias("rep"), "via", "d"),
        "junctions",
    )
    tops = reps.where("hops = 0").select(*keys, "rep")
    fixed = tops.join(multi.withColumnRenamed("child", "rep"), [*keys, "rep"], "left_anti")
    if start is not None:
        fixed = fixed.join(start.withColumnRenamed("pos", "rep").withColumn("_on", F.lit(True)), [*keys, "rep"], "left")
        fixed = fixed.select(*keys, "rep", F.when(F.col("_on"), base).otherwise(F.lit(0).cast("double")).alias("value"))
    else:
        fixed = fixed.select(*keys, "rep", base.alias("value"))
    value = materialize(fixed, "relax")
    known = value
    if not joined.isEmpty():
        pending = joined
        # a junction is settled once the values of all its parents are known
        while not pending.isEmpty():
            got = pending.join(known.withColumnRenamed("rep", "via"), [*keys, "via"], "left")
            ready = (
                got.groupBy(*keys, "rep")
                .agg(F.count("*").alias("n"), F.count("value").alias("m"), combine(step).alias("value"))
                .where("n = m")
                .select(*keys, "rep", "value")
            )
            ready = materialize(ready, "relax")
            known = materialize(known.unionByName(ready), "relax")
            pending = materialize(pending.join(ready, [*keys, "rep"], "left_anti"), "junctions")
    return reps.join(known, [*keys, "rep"]).select(*keys, F.col("node").alias("pos"), "hops", "value")


def depth(
    nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV), root: int = 0, limit: int | None = None
) -> DataFrame:
    """Longest distance from a root: (keys, pos, depth); ``root`` is the depth given to roots."""

    def local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        got = _local_values(edges, keys).select(*keys, "pos", "depth")
        out = nodes.select(*keys, "pos").join(got, [*keys, "pos"], "left")
        return out.withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")) + root)

    def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        got = _relax(nodes, edges, keys, F.lit(0).cast("double"), F.col("value") + F.col("d") + 1, F.max)
        return got.select(*keys, "pos", (F.col("value") + F.col("hops") + root).cast("long").alias("depth"))

    return by_size(nodes, [edges], keys, limit, local, spread)


def path_counts(
    nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV), start: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Number of paths from a root (from ``start`` nodes only, if given) to every node, as DOUBLE."""

    def local(nodes: DataFrame, edges: DataFrame, *starts: DataFrame) -> DataFrame:
        rows, one = edges.select(*keys, "child", "parent"), F.lit(1.0)
        out = nodes.select(*keys, "pos")
        if starts:
            ok = starts[0].select(*keys, "pos")
            mark = lambda v: F.lit(v).cast("long").alias("parent")
            # -1 names an allowed start; -2 only says that starts are restricted at all
            rows = rows.unionByName(ok.select(*keys, F.col("pos").alias("child"), mark(-1)))
            rows = rows.unionByName(edges.select(*keys).distinct().select(*keys, F.lit(-1).cast("long").alias("child"), mark(-2)))
            out = out.join(ok.withColumn("_ok", F.lit(1.0)), [*keys, "pos"], "left")
            one = F.coalesce("_ok", F.lit(0.0))
        got = _local_values(rows, keys).select(*keys, "pos", "n_paths")
        out = out.join(got, [*keys, "pos"], "left")
        return out.select(*keys, "pos", F.coalesce("n_paths", one).alias("n_paths"))

    def spread(nodes: DataFrame, edges: DataFrame, *starts: DataFrame) -> DataFrame:
        got = _relax(nodes, edges, keys, F.lit(1).cast("double"), F.col("value"), F.sum, starts[0] if starts else None)
        return got.select(*keys, "pos", F.col("value").alias("n_paths"))

    return by_size(nodes, [edges] if start is None else [edges, start], keys, limit, local, spread)


# ---------------------------------------------------------------- components


def components(nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV), limit: int | None = None) -> DataFrame:
    """Weakly connected components: (keys, pos, comp) with comp = smallest position inside."""

    def local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        got = _local_values(edges, keys).select(*keys, "pos", "comp")
        out = nodes.select(*keys, "pos").join(got, [*keys, "pos"], "left")
        return out.withColumn("comp", F.coalesce("comp", "pos"))

    return by_size(nodes, [edges], keys, limit, local, lambda n, e: _components(n, e, keys))


def _components(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Components by hooking and doubling.

    Each round every label hooks onto its smallest neighbour and pointers are doubled to their end;
    edges between merged labels disappear.  Labels at least halve per round.
    """
    cur = edges.select(*keys, F.greatest("child", "parent").alias("hi"), F.least("child", "parent").alias("lo"))
    cur = materialize(cur.where("hi <> lo").distinct(), "cc")
    label = None
    while not cur.isEmpty():
        hook = cur.groupBy(*keys, F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        ends = chase(hook, keys).select(*keys, "node", "up")
        if label is None:
            label = ends
        else:
            nxt = ends.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"))
            moved = label.join(nxt, [*keys, "up"], "left").select(*keys, "node", F.coalesce("up2", "up").alias("up"))
            # a label that was its own component so far hooks for the first time
            fresh = ends.join(label.select(*keys, "node"), [*keys, "node"], "left_anti")
            label = materialize(moved.unionByName(fresh), "cc")
        hi = ends.select(*keys, F.col("node").alias("hi"), F.col("up").alias("hi2"))
        lo = ends.select(*keys, F.col("node").alias("lo"), F.col("up").alias("lo2"))
        step = cur.join(hi, [*keys, "hi"], "left").join(lo, [*keys, "lo"], "left")
        step = step.select(*keys, F.coalesce("hi2", "hi").alias("a"), F.coalesce("lo2", "lo").alias("b")).where("a <> b")
        cur = materialize(step.select(*keys, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    out = nodes.select(*keys, "pos")
    if label is None:
        return out.withColumn("comp", F.col("pos"))
    label = label.select(*keys, F.col("node").alias("pos"), F.col("up").alias("comp"))
    return out.join(label, [*keys, "pos"], "left").withColumn("comp", F.coalesce("comp", "pos"))


# ---------------------------------------------------------------- closures


def closure(nodes: DataFrame, edges: DataFrame, keys: Keys = tuple(CONV), limit: int | None = None) -> DataFrame:
    """All (node, anc) pairs, once each; the output is as large as the answer."""
    limit = LOCAL_PAIRS if limit is None else limit
    return by_size(nodes, [edges], keys, limit, lambda n, e: _local_closure(e, keys), lambda n, e: _closure(e, keys))


def ancestor_bits(children: list[int], parents: list[int]) -> dict[int, int]:
    """Ancestor sets as bit masks over positions; edges must come sorted by child."""
    bits: dict[int, int] = {}
    for child, parent in zip(children, parents):
        bits[child] = bits.get(child, 0) | bits.get(parent, 0) | (1 << parent)
    return bits


def ancestor_counts(gold: list[tuple[int, int]], pred: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """Number of gold, predicted and common ancestors of every gold child; edges (child, parent) come sorted."""
    sides = [tuple(np.array(side, dtype=np.int64).reshape(-1, 2).T) for side in (gold, pred)]
    kids, n_gold, [(n_pred, n_both)] = ancestor_sums(*sides[0], sides[1:])
    return {x: (a, b, c) for x, a, b, c in zip(kids.tolist(), n_gold.tolist(), n_pred.tolist(), n_both.tolist())}


Side = tuple[np.ndarray, np.ndarray]


def sorted_edges(child: np.ndarray, parent: np.ndarray) -> Side:
    """Edges by child and parent, each once."""
    at = np.lexsort((parent, child))
    child, parent = child[at], parent[at]
    new = np.ones(len(child), dtype=bool)
    new[1:] = (child[1:] != child[:-1]) | (parent[1:] != parent[:-1])
    return child[new], parent[new]


def ancestor_sums(child: np.ndarray, parent: np.ndarray, sides: Sequence[Side], low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, list[Side]]:
    """Gold children, the number of their gold ancestors, and for each side that of (its own, common) ancestors.

    Edges come sorted by child.  An ancestor of a gold child is a gold parent, so a set is a mask over
    the gold parents (and the parents of a side where messages have several) and not over all positions;
    where a side gives messages one parent, its ancestors are counted along the chain.  A mask is kept
    until the last child of its message, and as many bits are looked at together as masks of that many
    messages take ``MASK_BYTES``, ``BITS`` at least.  From ``low`` up to ``high`` only, if given.
    """
    kids = np.unique(child)
    inside = lambda x: np.unique(x[(x >= low) & ((x < high) if high is not None else True)])
    several = [len(c) > 1 and bool((c[1:] == c[:-1]).any()) for c, _ in sides]
    members = inside(np.concatenate([parent, *[p for (_, p), many in zip(sides, several) if many]]))
    ids = np.unique(np.concatenate([child, parent, members, *[x for side in sides for x in side]]))
    place = lambda x: np.searchsorted(ids, x)
    edges = [(place(c), place(p)) for c, p in ((child, parent), *sides)]
    wanted = bytearray(len(ids))
    for x in place(kids).tolist():
        wanted[x] = 1
    n_gold, out = np.zeros(len(kids), dtype=np.int64), []
    for (c, p), many in zip(edges[1:], several):
        own = np.zeros(len(kids), dtype=np.int64)
        if not many:
            counts = (ids >= low) & ((ids < high) if high is not None else True)
            deep = [0] * len(ids)
            for x, up, n in zip(c.tolist(), p.tolist(), counts[p].tolist()):
                deep[x] = deep[up] + n
            own = np.array(deep, dtype=np.int64)[place(kids)]
        out.append([own, np.zeros(len(kids), dtype=np.int64)])
    last, live = [], 1
    for c, p in edges:
        ends = np.full(len(ids), -1)
        np.maximum.at(ends, p, c)
        ups = np.flatnonzero(ends >= 0)
        gone = np.searchsorted(np.sort(ends[ups]), ups)
        live += int((np.arange(1, len(ups) + 1) - gone).max(initial=0))
        last.append(ends)
    bits = max(BITS, min(MASK_BITS, MASK_BYTES * 8 // live))
    lists, last, at = [(c.tolist(), p.tolist()) for c, p in edges], [x.tolist() for x in last], np.searchsorted(kids, ids).tolist()
    for begin in range(0, len(members), bits):
        part = members[begin : begin + bits]
        bit = np.full(len(ids), -1)
        bit[place(part)] = np.arange(len(part))
        first, bit = int(place(part[:1])[0]), bit.tolist()
        walks = [_masks(*lists[k], last[k], bit, wanted, first) for k in range(len(lists))]
        heads = [next(w, (len(ids), 0)) for w in walks[1:]]
        for x, theirs in walks[0]:
            n = at[x]
            n_gold[n] += theirs.bit_count()
            for k, (y, mask) in enumerate(heads):
                while y < x:
                    if several[k]:
                        out[k][0][at[y]] += mask.bit_count()
                    y, mask = heads[k] = next(walks[k + 1], (len(ids), 0))
                if y == x:
                    out[k][1][n] += (theirs & mask).bit_count()
        for k, (y, mask) in enumerate(heads):
            while several[k] and y < len(ids):
                out[k][0][at[y]] += mask.bit_count()
                y, mask = next(walks[k + 1], (len(ids), 0))
    return kids, n_gold, [tuple(x) for x in out]


def _masks(child: list[int], parent: list[int], last: list[int], bit: list[int], wanted: bytearray, first: int) -> Iterator[tuple[int, int]]:
    """Of each wanted message, in order, its ancestors that have a bit, as a mask; none: left out.

    ``last``: the last child of each parent, after which its mask is not needed any more.  No ancestor
    lies before ``first``.
    """
    masks: dict[int, int] = {}
    n, size = bisect_right(child, first), len(child)
    while n < size:
        x, mask, done = child[n], 0, []
        while n < size and child[n] == x:
            up = parent[n]
            above = masks.get(up)
            if above is None:
                above = 1 << bit[up] if bit[up] >= 0 else 0
            if above:
                mask = mask | above if mask and mask is not above else above
            if last[up] == x:
                done.append(up)
            n += 1
        for up in done:
            masks.pop(up, None)
        if mask:
            if last[x] >= 0:
                masks[x] = mask | (1 << bit[x]) if bit[x] >= 0 else mask
            if wanted[x]:
                yield x, mask


def next_to_gold(gold: DataFrame, preds: DataFrame, names: Sequence[str]) -> DataFrame:
    """(conversation, child, parent, side): gold edges as side 0, those of the n-th algorithm as side n."""
    nth = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("algorithm")).cast("int")
    own = preds.select(*CONV, "child", "parent", nth.alias("side")).where("side > 0")
    return gold.select(*CONV, "child", "parent", F.lit(0).alias("side")).unionByName(own)


def by_algorithm(both: DataFrame, names: Sequence[str]) -> DataFrame:
    """(algorithm, conversation, child, parent, is_gold): gold edges next to those of each algorithm."""
    every = F.array(*[F.lit(n) for n in names])
    mine = F.when(F.col("side") == 0, every).otherwise(F.array(F.get(every, F.col("side") - 1)))
    return both.select(F.explode(mine).alias("algorithm"), *CONV, "child", "parent", (F.col("side") == 0).alias("is_gold"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation: few bytes and much work, so partitions are not sized by what was shuffled."""
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CONV)


def sides_of(table: pa.Table, n: int) -> tuple[Side, list[Side]]:
    """Edges of one conversation: those of side 0, and of the sides 1 .. n."""
    child, parent, side = (table[c].to_numpy() for c in ("child", "parent", "side"))
    first, *rest = (sorted_edges(child[side == k], parent[side == k]) for k in range(n + 1))
    return first, rest


def keyed_tables(table: pa.Table, names: Sequence[str], rows: Sequence[dict]) -> pa.Table:
    """The columns found for each algorithm, under its name and the conversation's keys."""
    out = []
    for name, cols in zip(names, rows):
        cols = {k: pa.array(v) for k, v in cols.items()}
        size = len(next(iter(cols.values())))
        keys = {k: pa.repeat(table[k][0], size) for k in CONV}
        out.append(pa.table({"algorithm": pa.repeat(pa.scalar(name), size), **keys, **cols}))
    return pa.concat_tables(out)


def ancestor_bands(nodes: DataFrame, both: DataFrame, keys: Keys) -> DataFrame:
    """(keys, child, n_gold, n_pred, n_both): :func:`ancestor_counts` of conversations too large for one task.

    ``both(keys, child, parent, is_gold)``.  A task counts the ancestors in one stretch of positions
    (``BANDS`` times ``BITS``), from the edges behind it; no pair of a message and an ancestor is listed.
    """
    keys, width = list(keys), BANDS * BITS

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gold, pred = (sorted_edges(s["child"].to_numpy(), s["parent"].to_numpy()) for s in (pdf[pdf["is_gold"]], pdf[~pdf["is_gold"]]))
        low = int(key[-1]) * width
        kids, n_gold, [(n_pred, n_both)] = ancestor_sums(*gold, [pred], low, low + width)
        out = pd.DataFrame({"child": kids, "n_gold": n_gold, "n_pred": n_pred, "n_both": n_both})
        for k, v in zip(reversed(keys), reversed(key[:-1])):
            out.insert(0, k, v)
        return out

    bands = F.sequence(F.lit(0).cast("long"), F.floor((F.col("child") - 1) / width))
    rows = both.where("child > 0").select(*keys, "child", "parent", "is_gold", F.explode(bands).alias("_band"))
    # few bytes and much work: partitions must not be sized by what was shuffled
    rows = rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_band")
    got = rows.groupBy(*keys, "_band").applyInPandas(count, keyed_schema(both, keys, "child long, n_gold long, n_pred long, n_both long"))
    return got.groupBy(*keys, "child").agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_pred", "n_both")])


def _local_closure(edges: DataFrame, keys: Keys) -> DataFrame:
    keys = list(keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child")
        rows = []
        for node, mask in ancestor_bits(pdf["child"].tolist(), pdf["parent"].tolist()).items():
            while mask:
                low = mask & -mask
                rows.append((*key, node, low.bit_length() - 1))
                mask ^= low
        return pd.DataFrame(rows, columns=[*keys, "node", "anc"])

    schema = keyed_schema(edges, keys, "node long, anc long")
    return edges.select(*keys, "child", "parent").groupBy(*keys).applyInPandas(solve, schema)


def _closure(edges: DataFrame, keys: Keys) -> DataFrame:
    """Double the pair table until it stops growing."""
    pairs = materialize(edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("anc")).distinct(), "closure")
    size = pairs.count()
    while True:
        mid = pairs.select(*keys, F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        longer = pairs.join(mid, [*keys, "anc"]).select(*keys, "node", F.col("anc2").alias("anc"))
        grown = materialize(pairs.unionByName(longer).distinct(), "closure")
        now = grown.count()
        if now == size:
            return grown
        pairs, size = grown, now


def hop_closure(ptr_edges: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Ancestors of single-parent edges with their distance: (keys, node, anc, hops)."""
    pairs = materialize(
        ptr_edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("anc"), F.lit(1).cast("long").alias("hops")),
        "hops",
    )
    reach = 1
    while True:
        mid = pairs.select(*keys, F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("h2"))
        longer = (
            pairs.where(F.col("hops") == reach)
            .join(mid, [*keys, "anc"])
            .select(*keys, "node", F.col("anc2").alias("anc"), (F.col("hops") + F.col("h2")).alias("hops"))
        )
        longer = materialize(longer, "hops")
        if longer.isEmpty():
            return pairs
        pairs = pairs.unionByName(longer)
        reach *= 2


def is_ancestor(pairs: DataFrame, ptr_edges: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Keep the (node, anc) pairs where ``anc`` lies above ``node`` in a single-parent forest.

    Jumps of falling powers of two that never pass ``anc``; the forest's own closure, which grows
    with the square of chain lengths, is never built.
    """
    single = ptr_edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"))
    _, steps = chase(single, keys, keep_steps=True)
    cur = pairs.withColumn("_x", F.col("node"))
    for n, table in enumerate(reversed(steps)):
        jump = table.select(*keys, F.col("node").alias("_x"), F.col("up").alias("_to"))
        cur = cur.join(jump, [*keys, "_x"], "left").withColumn(
            "_x", F.when(F.col("_to") >= F.col("anc"), F.col("_to")).otherwise(F.col("_x"))
        ).drop("_to")
        if n % 6 == 5:
            cur = materialize(cur, "lift")
    return cur.where("_x = anc").drop("_x")


# ---------------------------------------------------------------- cycles


def cyclic(ptr: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Nodes of a one-pointer-per-node graph (node -> up) that never reach an end.

    (keys, node, lowest) with the smallest node met on the way.  A walk without a cycle ends after
    fewer hops than there are pointers, so pointers are doubled that often; whoever still has a
    pointer afterwards runs into a cycle.
    """
    cur = materialize(ptr.select(*keys, "node", "up", F.col("node").alias("lowest")), "cycle")
    longest = cur.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    span = 1
    while span <= longest and not cur.isEmpty():
        onward = cur.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("lowest").alias("low2"))
        # a pointer onto a node without pointer has reached the end and drops out
        hop = cur.join(onward, [*keys, "up"])
        cur = materialize(hop.select(*keys, "node", F.col("up2").alias("up"), F.least("lowest", "low2").alias("lowest")), "cycle")
        span *= 2
    return cur.select(*keys, "node", "lowest")


def break_cycles(ptr: DataFrame, keys: Keys = tuple(CONV)) -> DataFrame:
    """Turn nodes into roots, in order of position, until no walk meets a cycle: pointers kept.

    Going through the nodes in order, a node is cut exactly if its walk runs into a cycle and no
    smaller node lies on that walk (a smaller one would have been cut before).
    """
    cut = cyclic(ptr, keys).where("node = lowest").select(*keys, "node")
    return ptr.join(cut, [*keys, "node"], "left_anti")

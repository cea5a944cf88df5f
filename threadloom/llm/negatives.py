"""Hard negatives of messages: close vectors of other threads, found in a multiway hyperplane tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize, tune

#: Split points of a node.
FANOUT = 16
#: Rows of a leaf that are compared at a time; larger leaves are dealt to blocks of about this size.
LEAF_ROWS = 4096
#: Rows the split points are chosen from at most, and bytes of their vectors at most.
SAMPLE, SAMPLE_BYTES = 16_384, 32_000_000
#: Largest size of a component after scaling; larger ones count as this.
LARGEST = 2**28
#: Anchors that a task compares with a leaf at a time.
SLICE = 256

_NONE = np.iinfo(np.int64).min


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    top = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if top[0] * top[1] * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` numbers; missing ones are 0."""
    column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


@dataclass
class Tree:
    """Split points of the inner nodes, and what lies below each: a node (>= 0) or leaf -1 - number.

    Vectors x are seen as points (x, sqrt(R^2 - |x|^2)) on a sphere of radius R, the longest length of
    all, and anchors q as (q, 0): then |q|^2 + R^2 - 2 qx is their squared distance, and a window of
    scores is an annulus.  ``near[node][i, j]`` and ``far`` are the smallest and largest distance of
    split point i to the rows below its sibling j.
    """

    radius2: float
    dim: int
    points: list[np.ndarray] = field(default_factory=list)
    below: list[np.ndarray] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)
    far: list[np.ndarray] = field(default_factory=list)
    n_leaves: int = 1
    blocks: np.ndarray = field(default_factory=lambda: np.array([0, 1]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius2 - (x.astype(float) ** 2).sum(1), 0))

    def between(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distances of rows to split points."""
        return np.sqrt(np.maximum(2 * (self.radius2 - x.astype(float) @ p.T.astype(float) - np.outer(self.lift(x), self.lift(p))), 0))

    def from_anchor(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.radius2 - 2 * q @ p.T.astype(float), 0))

    def annulus(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest distance that scores from ``low`` to ``high`` mean, a little widened."""
        base = (q.astype(float) ** 2).sum(1) + self.radius2
        slack = 1e-6 * (1 + np.sqrt(base))
        return np.sqrt(np.maximum(base - 2.0 * high, 0)) - slack, np.sqrt(np.maximum(base - 2.0 * low, 0)) + slack

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows there, their distances to its split points, the nearest); leaves are in ``self.place``."""
        self.place = np.zeros(len(x), np.int64) if self.points else np.full(len(x), -1)
        for node, points in enumerate(self.points):
            rows = np.flatnonzero(self.place == node)
            if len(rows):
                d = self.between(x[rows], points)
                j = d.argmin(1)
                self.place[rows] = self.below[node][j]
                yield node, rows, d, j
        self.place = -1 - self.place

    def visits(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) for the leaves that may hold a score in the window of the anchor.

        A sibling goes where the ranges of distances that its split points know rule the annulus out.
        """
        inner, outer = self.annulus(q, low, high)
        open_ = [(0, np.flatnonzero(high >= low))] if self.points else []
        found = [] if self.points else [(np.flatnonzero(high >= low), np.zeros(int((high >= low).sum()), np.int64))]
        while open_:
            node, rows = open_.pop()
            d = self.from_anchor(q[rows], self.points[node])[:, :, None]
            least = np.maximum(d - self.far[node], self.near[node] - d).max(1)
            most = (d + self.far[node]).min(1)
            stays = (least <= outer[rows, None]) & (most >= inner[rows, None])
            for j, child in enumerate(self.below[node].tolist()):
                left = rows[stays[:, j]]
                if len(left):
                    open_.append((child, left)) if child >= 0 else found.append((left, np.full(len(left), -1 - child)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def grow(sample: np.ndarray, n_rows: int, radius2: float, dim: int) -> Tree:
    """The tree over a sample: nodes are split until a leaf stands for LEAF_ROWS rows or holds too few to split."""
    tree = Tree(radius2, dim)
    rng, leaves = np.random.default_rng(11), 0
    open_ = [(np.arange(len(sample)), None)]
    while open_:
        rows, at = open_.pop(0)
        part = None
        if len(rows) * n_rows > LEAF_ROWS * len(sample) and len(rows) >= 2 * FANOUT:
            part = _split(tree, sample, rows, rng)
        if part is None:
            target, leaves = -1 - leaves, leaves + 1
        else:
            picked, j = part
            target = len(tree.points)
            tree.points.append(sample[picked])
            tree.below.append(np.zeros(len(picked), np.int64))
            m = len(picked)
            tree.near.append(np.full((m, m), np.inf))
            tree.far.append(np.full((m, m), -np.inf))
            open_ += [(rows[j == k], (target, k)) for k in range(m)]
        if at is not None:
            tree.below[at[0]][at[1]] = target
    tree.n_leaves = leaves
    return tree


def _split(tree: Tree, sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Split points that lie far apart, and the nearest one of each row; none if the rows do not separate."""
    pool = rng.choice(rows, min(len(rows), 4 * FANOUT), replace=False)
    d = tree.between(sample[pool], sample[pool])
    chosen, gap = [0], d[0].copy()
    while len(chosen) < FANOUT and gap.max() > 1e-3:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, d[chosen[-1]])
    if len(chosen) < 2:
        return None
    picked = pool[chosen]
    j = tree.between(sample[rows], sample[picked]).argmin(1)
    return (picked, j) if np.bincount(j).max() < len(rows) else None


def best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row; of equal ones the first columns."""
    r, c = np.nonzero(ok)
    order = np.lexsort((c, -score[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def _prepared(messages: DataFrame, anchors: Column, keys: list[str], scale: int) -> DataFrame:
    """The rows that take part: keys, thread, integer vector ``q`` and its squared length, anchor or not."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    known = F.col("thread").isNotNull() & F.col("vector").isNotNull() & finite
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = messages.withColumn("_anchor", F.coalesce(anchors, F.lit(False))).where(known)
    rows = rows.select(*keys, F.col("thread").cast("string").alias("thread"), F.transform("vector", whole).alias("q"), F.col("_anchor"), F.xxhash64(*keys).alias("_k"), F.rand(5).alias("_draw"))
    length = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return materialize(rows.select("*", length.alias("_length"), F.monotonically_increasing_id().alias("_a")), "vectors")


def _indexed(rows: DataFrame) -> tuple[DataFrame, Tree, pa.Table]:
    """Rows with the block of their leaf, the tree with ranges over all rows, and the sample it was grown from."""
    spark = rows.sparkSession
    n, length, dim = rows.agg(F.count("*"), F.max("_length"), F.max(F.size("q"))).first()
    dim = max(dim or 0, 1)
    want = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = rows.where(F.col("_draw") < want / max(n, 1)).select("thread", "q", "_k").toArrow()
    tree = grow(matrix(sample["q"], dim), n, float(length or 0), dim)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, x = shared.value, matrix(b["q"], dim)
            for _ in t.descend(x):
                pass
            yield b.append_column("_leaf", pa.array(t.place, pa.int64()))

    laid = materialize(rows.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", _leaf long"), "leaves")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        near, far = [x.copy() for x in t.near], [x.copy() for x in t.far]
        for b in batches:
            for node, _, d, j in t.descend(matrix(b["q"], dim)):
                for k in np.unique(j):
                    mine = d[j == k]
                    near[node][:, k] = np.minimum(near[node][:, k], mine.min(0))
                    far[node][:, k] = np.maximum(far[node][:, k], mine.max(0))
        for node, (lo, hi) in enumerate(zip(near, far, strict=True)):
            i, j = np.nonzero(lo <= hi)
            if len(i):
                yield pa.RecordBatch.from_pydict({"node": np.full(len(i), node), "i": i, "j": j, "lo": lo[i, j], "hi": hi[i, j]})

    if tree.points:
        seen = laid.select("q").mapInArrow(measure, "node long, i long, j long, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi"))
        for node, i, j, lo, hi in seen.collect():  # at most FANOUT^2 numbers for each node of the tree
            tree.near[node][i, j], tree.far[node][i, j] = lo, hi
    counts = dict(laid.groupBy("_leaf").count().collect())  # one number a leaf
    per_leaf = [max(1, -(-counts.get(k, 0) // LEAF_ROWS)) for k in range(tree.n_leaves)]
    tree.blocks = np.concatenate([[0], np.cumsum(per_leaf)]).astype(np.int64)
    shared.unpersist()
    start, many = (F.array(*[F.lit(int(v)) for v in vs]) for vs in (tree.blocks[:-1], per_leaf))
    at = F.col("_leaf").cast("int")
    dealt = F.get(start, at) + F.floor(F.col("_draw") * F.get(many, at))
    return laid.withColumn("_block", dealt.cast("long")).drop("_leaf", "_draw", "_length"), tree, sample


def _codes(threads: pa.Array | pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(threads, known), -1).to_numpy()


def _search(indexed: DataFrame, tree: Tree, sample: pa.Table, queries: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each window of the queries: (_a, window, keys, score, nth).

    queries(keys, thread, q, _k, _a, lows, highs): windows of scores, bounds included.  Rows of the
    sample give a first bound of each window; the tree tells the leaves that may still hold better
    ones; anchors travel to these, never rows.  A leaf's rows are held once, anchors stream past.
    """
    spark = indexed.sparkSession
    names = [*keys, "thread", "q", "_k", "_a"]
    types = dict(indexed.dtypes)
    shape = indexed.select(*names).limit(0).toArrow().schema
    longs = pa.list_(pa.int64())
    routed = pa.schema([*shape, ("_block", pa.int64()), ("lows", longs), ("highs", longs)])
    found = pa.schema([("_a", pa.int64()), ("window", pa.int64()), *[shape.field(c) for c in keys], ("score", pa.int64())])
    kept, dim = spark.sparkContext.broadcast((tree, sample)), tree.dim

    def windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, low, high) of all windows of a table of queries."""
        sizes = pc.list_value_length(t["lows"]).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, number, *[pc.list_flatten(t[c]).to_numpy().astype(np.int64) for c in ("lows", "highs")]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample = kept.value
        known = pc.unique(sample["thread"])
        mine, points, ids = _codes(sample["thread"], known), matrix(sample["q"], dim), sample["_k"].to_numpy()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                t = pa.Table.from_batches([batch.slice(at, SLICE)])
                q = matrix(t["q"], dim)
                row, _, low, high = windows(t)
                ok = ((_codes(t["thread"], known)[:, None] == mine) == same) & (t["_k"].to_numpy()[:, None] != ids)
                s = np.where(ok, scores(q, points), _NONE)[row]
                s = np.where((s >= low[:, None]) & (s <= high[:, None]), s, _NONE)
                if s.shape[1] >= k:
                    low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                which, leaf = tree.visits(q[row], low, high)
                pair = np.unique(np.stack([row[which], leaf], 1), axis=0)
                n = tree.blocks[pair[:, 1] + 1] - tree.blocks[pair[:, 1]]
                block = np.arange(n.sum()) + np.repeat(tree.blocks[pair[:, 1]] - (np.cumsum(n) - n), n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(q)))])
                lows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low))
                highs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(high))
                t = t.select(names).append_column("lows", lows).append_column("highs", highs)
                for part in range(0, len(block), 4096):
                    out = t.take(np.repeat(pair[:, 0], n)[part : part + 4096]).append_column("_block", pa.array(block[part : part + 4096]))
                    yield from out.select(routed.names).cast(routed).to_batches()

    def compare(block: pa.Table, t: pa.Table) -> Iterator[pa.RecordBatch]:
        known = pc.unique(block["thread"])
        mine, x = _codes(block["thread"], known), matrix(block["q"], dim)
        ids = {key: pc.unique(block[key]) for key in keys}
        own = {key: _codes(block[key], ids[key]) for key in keys}
        for at in range(0, t.num_rows, SLICE):
            part = t.slice(at, SLICE)
            q = matrix(part["q"], dim)
            ok = (_codes(part["thread"], known)[:, None] == mine) == same
            ok &= ~np.logical_and.reduce([_codes(part[key], ids[key])[:, None] == own[key] for key in keys])
            s = scores(q, x)
            row, number, low, high = windows(part)
            wide = s[row]
            r, c = best(wide, ok[row] & (wide >= low[:, None]) & (wide <= high[:, None]), k)
            if len(r):
                out = block.select(keys).take(c)
                cols = {"_a": part["_a"].to_numpy()[row[r]], "window": number[r], **{key: out[key] for key in keys}, "score": wide[r, c]}
                yield from pa.table(cols).cast(found).combine_chunks().to_batches()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            number, kind = batch["_block"].to_numpy(), batch["lows"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if number[a] != current:
                    current, held, block = number[a], [], None
                if not kind[a]:
                    held.append(part)
                elif held or block is not None:
                    if block is None:
                        block = pa.Table.from_batches(held).sort_by([(key, "ascending") for key in keys]).combine_chunks()
                        held = []
                    yield from compare(block, pa.Table.from_batches([part]))

    kinds = ", ".join(f"{c} {types[c]}" for c in names)
    asked = queries.select(*names, "lows", "highs").mapInArrow(route, kinds + ", _block long, lows array<long>, highs array<long>")
    none = F.lit(None).cast("array<long>")
    both = indexed.select(*names, "_block", none.alias("lows"), none.alias("highs")).unionByName(asked)
    laid = both.repartition("_block").sortWithinPartitions("_block", F.col("lows").isNotNull())
    hits = laid.mapInArrow(visit, "_a long, window long, " + ", ".join(f"{c} {types[c]}" for c in keys) + ", score long")
    order = Window.partitionBy("_a", "window").orderBy(F.desc("score"), *keys)
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def hard_negatives(messages: DataFrame, anchors: Column, keys: Sequence[str] = ("msg_id",), scale: int = 256, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and positive, messages of other threads that score almost as high.

    messages(keys, thread, vector array of numbers); ``anchors`` is a condition on them.  Components
    become floor(scale * x), as doubles; a score is the inner product of these integers.  Positives
    of an anchor are the ``n_positives`` best other messages of its thread; its negatives for a positive
    of score p the ``n_negatives`` best messages of other threads with low * p <= 100 * score <= high * p;
    equal scores come by key.  Fewer are returned where there are fewer.  Result: anchor_<key>,
    positive_<key>, rank (from 1), negative_<key>, positive_score, negative_score.

    The search is exact.  Split points of a GNAT-style tree are chosen from a sample (SAMPLE rows and
    SAMPLE_BYTES at most, on the driver); every row is in a leaf, and the ranges of distances between
    split points and siblings cover all rows.  A leaf above LEAF_ROWS is dealt to blocks.  Anchors go to
    the leaves that the ranges leave for their annuli, so work and exchange grow as anchors times
    such leaves: where all vectors are about equally far from each other, that is all of them.

    Messages without key, thread or vector, or with a component that is null or not finite, take no
    part.  A message of the anchor's key is never its partner; messages that repeat a key otherwise
    count one by one, also as anchors.  Shorter vectors count as filled up with 0; components beyond
    LARGEST after scaling count as that.  Other columns are ignored; an empty table gives no row.
    """
    tune(messages.sparkSession)
    keys = list(keys)
    rows = _prepared(messages, anchors, keys, scale)
    indexed, tree, sample = _indexed(rows)
    asked = rows.where("_anchor").select(*keys, "thread", "q", "_k", "_a")
    everything = [F.array(F.lit(v).cast("long")) for v in (-(2**62), 2**62)]
    positives = _search(indexed, tree, sample, asked.withColumns(dict(zip(("lows", "highs"), everything, strict=True))), keys, True, n_positives)
    positives = materialize(positives.drop("window"), "positives")

    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    bounds = F.struct("nth", (-floor(f"(-{low} * score)")).alias("low"), floor(f"({high} * score)").alias("high"))
    bounds = positives.groupBy("_a").agg(F.array_sort(F.collect_list(bounds)).alias("_w"))  # n_positives at most
    asked = asked.join(bounds, "_a").select(*keys, "thread", "q", "_k", "_a", F.col("_w.low").alias("lows"), F.col("_w.high").alias("highs"))
    negatives = _search(indexed, tree, sample, asked, keys, False, n_negatives)

    named = lambda df, name: df.select("_a", *[F.col(k).alias(f"{name}_{k}") for k in keys], *[c for c in df.columns if c not in ("_a", *keys)])
    out = named(negatives, "negative").withColumnsRenamed({"score": "negative_score", "nth": "rank"}).withColumn("nth", F.col("window") + 1)
    out = out.join(named(positives, "positive").withColumnRenamed("score", "positive_score"), ["_a", "nth"]).join(named(rows.where("_anchor").select("_a", *keys), "anchor"), "_a")
    of = lambda name: [f"{name}_{k}" for k in keys]
    return out.select(*of("anchor"), *of("positive"), F.col("rank").cast("int").alias("rank"), *of("negative"), "positive_score", "negative_score")

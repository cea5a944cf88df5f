"""op11: hard negatives against comparing everything, pruning of the tree, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import negatives
from threadloom.llm.negatives import Tree, best, grow, hard_negatives, scores

SCHEMA = "msg_id long, thread string, vector array<double>"


def brute(rows, anchor, n_positives=5, n_negatives=3):
    """Sorted results from all pairs; rows are (key, thread, vector)."""
    good = [(k, t, [min(max(math.floor(256 * x), -(2**28)), 2**28) for x in v]) for k, t, v in rows if k is not None and t is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, t, v in good:
        if not anchor(k):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, u) for j, u, w in good if j != k)  # noqa: B905
        for p, j in [(-s, j) for s, j, u in scored if u == t][:n_positives]:
            hard = [(-s, i) for s, i, u in scored if u != t and 50 * p <= -100 * s <= 95 * p][:n_negatives]
            out += [(k, j, n + 1, i, p, s) for n, (s, i) in enumerate(hard)]
    return sorted(out)


def clusters(seed, n, dim=6, threads=4, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((threads, dim))
    which = rng.integers(0, threads, n)
    v = np.round(centres[which] + spread * rng.standard_normal((n, dim)), 2)
    v[: n // 5] = v[0]  # many equal vectors
    thread = np.where(rng.random(n) < 0.3, rng.integers(0, threads, n), which)
    return [(int(k), f"t{t}", [float(x) for x in row]) for k, (t, row) in enumerate(zip(thread, v, strict=True))]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("leaf", "fanout", "spread"), [(20, 4, 0.15), (7, 2, 1.0), (4096, 16, 0.15)])
def test_brute_force(spark, monkeypatch, leaf, fanout, spread):
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "FANOUT", fanout)
    rows = clusters(leaf, 240, spread=spread)
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("msg_id") % 5 == 0))
    assert got and got == brute(rows, lambda k: k % 5 == 0)


def tree_over(x, leaf, fanout, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "FANOUT", fanout)
    tree = grow(x, len(x), float((x**2).sum(1).max()), x.shape[1])
    for node, _, d, j in tree.descend(x):
        for k in range(len(tree.points[node])):
            if (j == k).any():
                tree.near[node][:, k], tree.far[node][:, k] = d[j == k].min(0), d[j == k].max(0)
    return tree, tree.place


def test_visits_lose_nothing_and_prune(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.floor(256 * (4 * rng.standard_normal((20, 8))[rng.integers(0, 20, 4000)] + 0.1 * rng.standard_normal((4000, 8)))).astype(np.int64)
    tree, leaf = tree_over(x, 100, 8, monkeypatch)
    assert leaf.min() >= 0 and tree.n_leaves > 8 and len(np.unique(leaf)) > 8
    q = x[:50]
    s = scores(q, x)
    high = s.max(1) - 1
    low = np.sort(s, axis=1)[:, -20]
    row, at = tree.visits(q, low, high)
    seen = set(zip(row.tolist(), at.tolist(), strict=True))
    for r, c in zip(*np.nonzero((s >= low[:, None]) & (s <= high[:, None])), strict=True):
        assert (r, leaf[c]) in seen
    assert len(seen) < 0.5 * len(q) * tree.n_leaves


def test_tree_without_split():
    tree = Tree(4.0, 2)
    row, leaf = tree.visits(np.ones((3, 2), np.int64), np.array([0, 5, 0]), np.array([1, 2, 1]))
    assert row.tolist() == [0, 2] and leaf.tolist() == [0, 0]
    assert grow(np.zeros((100, 3), np.int64), 10**6, 0.0, 3).n_leaves == 1


def test_scores_are_exact():
    a = np.array([[2**28, -(2**28)], [1, 3]])
    assert scores(a, a).tolist() == [[2**57, -(2**29)], [-(2**29), 10]]


def test_best_takes_first_of_equal():
    s = np.array([[5, 7, 7, 7], [1, 1, 1, 1]])
    r, c = best(s, np.array([[True] * 4, [False, True, True, False]]), 2)
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_hot_leaf_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 10)
    rows = [(k, f"t{k % 2}", [1.0 + (k == 3), 0.5]) for k in range(100)]
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("msg_id") % 10 == 0))
    assert got == brute(rows, lambda k: k % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, "a", [1.0, 2.0]), (1, "a", [1.0, 1.9]), (2, "b", [1.0, 1.6]), (3, "b", [nan, 1.0]), (4, None, [1.0, 1.5]), (5, "b", None), (6, "b", [None, 1.0]), (7, "b", [inf, 1.0])]
    rows += [(8, "b", []), (9, "b", [2.0]), (10, "b", [1.0, 1.5, 0.0]), (None, "b", [1.0, 1.5]), (11, "a", [1e30, 0.0]), (12, "", [-1.0, -1.0]), (12, "", [-1.0, -1.0]), (0, "a", [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", q string, _draw int").withColumn("score", F.lit(1))
    assert found(hard_negatives(df, F.col("msg_id") >= 0)) == brute(rows, lambda k: True)
    assert hard_negatives(df.limit(0), F.col("msg_id") >= 0).count() == 0
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_messages_of_reply_threads(spark, sf):
    """The library's records: hashed texts as vectors, components of reply edges as threads, positions as keys."""
    from threadloom.functions.vectors import with_hash_vector
    from threadloom.operators.graph import components
    from threadloom.plans.tables import gold, messages

    keys = ["dataset", "conv_id", "pos"]
    msgs = messages(spark, sf)
    thread = components(msgs, gold(spark, sf)).select(*keys, F.concat_ws(":", "conv_id", "comp").alias("thread"))
    rows = with_hash_vector(msgs).join(thread, keys).select(*keys, "thread", F.col("vec").alias("vector")).where("conv_id < 'f'")
    rng = random.Random(1)
    kept = [r for r in rows.collect() if rng.random() < 0.4]
    df = spark.createDataFrame(kept, rows.schema)
    got = hard_negatives(df, F.col("pos") % 4 == 0, keys=keys)
    want = brute([((r.dataset, r.conv_id, r.pos), r.thread, r.vector) for r in kept], lambda k: k[2] % 4 == 0)
    assert want and found(got) == sorted((*a, *p, n, *i, s, t) for a, p, n, i, s, t in want)

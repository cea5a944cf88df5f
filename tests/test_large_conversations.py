"""Chain metrics of conversations as large as a grouped task may hold, and the same by joins."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import chain_metrics as cm
from threadloom.operators import chains, graph, layers

EDGE = "dataset string, conv_id string, child long, parent long"


def test_ancestor_counts_are_those_of_sets(monkeypatch):
    rng = random.Random(5)
    draw = lambda: sorted({(x, rng.randrange(max(0, x - 30), x)) for x in range(1, 300) for _ in range(rng.randrange(3))})
    gold, pred = draw(), draw()
    want = []
    for edges in (gold, pred):
        above: dict[int, set] = {}
        for child, parent in edges:
            above.setdefault(child, set()).update(above.get(parent, ()), [parent])
        want.append(above)
    for bits in (7, 64, 8192):
        monkeypatch.setattr(graph, "BITS", bits)
        got = graph.ancestor_counts(gold, pred)
        assert got == {x: (len(a), len(want[1].get(x, ())), len(a & want[1].get(x, set()))) for x, a in want[0].items()}


def test_long_chain_needs_no_square_of_memory():
    """40,000 messages in one chain: ancestor masks of all positions would take 100 MB a side, lists of chains 6 GB."""
    import tracemalloc

    n = 40_000
    edges = pd.DataFrame({"child": range(1, n), "parent": range(n - 1)})
    both = pd.concat([edges.assign(is_gold=True), edges.assign(is_gold=False), pd.DataFrame({"child": [-1], "parent": [n], "is_gold": [True]})])
    tracemalloc.start()
    row = cm._conversation_counts(("a", "d", "c"), both).iloc[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (row["jaccard_sum"], row["n_anc_msgs"], row["n_shared_paths"]) == (n - 1, n - 1, 1)
    assert peak < 90e6
    assert graph.LOCAL_MSGS >= n and graph.LOCAL_SETS >= n


def forests(spark, n=60):
    rng = random.Random(3)
    nodes, gold, preds = [], [], []
    for k in range(3):
        c = f"c{k}"
        nodes += [("d", c, p) for p in range(n)]
        gold += [("d", c, p, rng.randrange(max(0, p - 4), p)) for p in range(1, n) if rng.random() < 0.7]
        preds += [("x", "d", c, p, q if rng.random() < 0.8 else p - 1) for _, d, p, q in gold if d == c]
        preds += [("y", "d", c, p, p - 1) for p in range(1, n)]
    return (
        spark.createDataFrame(nodes, "dataset string, conv_id string, pos long"),
        spark.createDataFrame(gold, EDGE),
        spark.createDataFrame(preds, f"algorithm string, {EDGE}"),
    )


def test_chains_compared_without_listing_them(spark):
    nodes, gold, preds = forests(spark)
    listed = {(r.conv_id, r.pos): r.chain for r in chains.chains(nodes, gold).collect()}
    for limit in (None, 0):
        got = layers.chain_pairs(nodes, gold, preds, ["x", "y"], limit).collect()
        assert len(got) == 2 * len(listed)
        for name in ("x", "y"):
            other = {(r.conv_id, r.pos): r.chain for r in chains.chains(nodes, preds.where(f"algorithm = '{name}'").drop("algorithm")).collect()}
            for r in got:
                if r.algorithm == name:
                    g, p = listed[r.conv_id, r.pos], other[r.conv_id, r.pos]
                    agree = next((k for k in range(3) if k >= min(len(g), len(p)) or g[k] != p[k]), 3)
                    assert (r.n_g, r.n_p, r.shared, r.same, r.agree) == (len(g), len(p), len(set(g) & set(p)), g == p, agree), (limit, r)


def test_recalled_candidates(spark):
    rng = random.Random(2)
    themes = [rng.choice(["a", "b", None]) for _ in range(2100)]
    msgs = spark.createDataFrame([("d", "c", p, x) for p, x in enumerate(themes)], "dataset string, conv_id string, pos long, theme string")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    got = chains.recall_sizes(msgs)
    assert exchanges(got) <= 2  # eight copies of every message were dealt and joined before
    for r in got.collect():
        x = themes[r.pos]
        far = sum(themes[q] == x for q in range(max(0, r.pos - 8))) if x is not None else themes[: r.pos].count(None)
        assert r.n_candidates == 1 + min(r.pos, 8) + far


def test_ancestors_of_large_conversations_are_counted_by_stretches(spark, monkeypatch):
    """Messages with several parents on both sides; their ancestors were listed in pairs before."""
    from threadloom.session import intermediates

    rng = random.Random(8)
    draw = lambda: {(x, rng.randrange(max(0, x - 20), x)) for x in range(1, 120) for _ in range(rng.randrange(3))}
    nodes = spark.createDataFrame([("d", c, p) for c in "ab" for p in range(120)], "dataset string, conv_id string, pos long")
    gold = spark.createDataFrame([("d", c, *e) for c in "ab" for e in draw()], EDGE)
    preds = spark.createDataFrame([(n, "d", c, *e) for n in "xy" for c in "ab" for e in draw()], f"algorithm string, {EDGE}")
    table = lambda limit: {(r.algorithm, r.conv_id, r.child): r.jaccard for r in cm.ancestor_overlap(nodes, gold, preds, ["x", "y"], limit).collect()}
    want = table(None)
    monkeypatch.setattr(graph, "BITS", 16)
    with intermediates() as paths:
        assert table(0) == want
    assert not [p for p in paths if "/closure-" in p]


def test_sets_are_masks_over_gold_parents_only(monkeypatch):
    """100,000 messages that answer one of 50: every 8,192 positions were a round of their own before."""
    n, rounds, walk = 100_000, [], graph._masks
    monkeypatch.setattr(graph, "_masks", lambda *a: rounds.append(1) or walk(*a))
    gold = [(x, x % 50) for x in range(50, n)]
    got = graph.ancestor_counts(gold, [(x, x - 1) for x in range(1, n)])
    assert len(rounds) == 2
    assert len(got) == n - 50 and set(got.values()) == {(1, x, 1) for x in range(50, n)}


def test_sums_of_several_sides_by_parts(monkeypatch):
    rng = random.Random(6)
    draw = lambda n: sorted({(x, rng.randrange(max(0, x - 30), x)) for x in range(1, 300) for _ in range(rng.randrange(n))})
    gold, several, single = draw(3), draw(3), draw(2)
    above = []
    for edges in (gold, several, single):
        above.append({})
        for child, parent in edges:
            above[-1].setdefault(child, set()).update(above[-1].get(parent, ()), [parent])
    split = lambda edges: tuple(np.array(edges).T)
    monkeypatch.setattr(graph, "MASK_BYTES", 0)
    monkeypatch.setattr(graph, "BITS", 7)
    for low, high in ((0, None), (40, 111)):
        kids, n_gold, found = graph.ancestor_sums(*split(gold), [split(several), split(single)], low, high)
        inside = lambda side, x: {y for y in side.get(x, ()) if low <= y and (high is None or y < high)}
        for k, x in enumerate(kids.tolist()):
            sets = [inside(side, x) for side in above]
            assert n_gold[k] == len(sets[0])
            for (own, common), mine in zip(found, sets[1:]):
                assert (own[k], common[k]) == (len(mine), len(mine & sets[0]))


def test_counts_of_algorithms_and_unknown_keys(spark):
    nodes, gold, preds = forests(spark, 40)
    hidden = lambda df: df.union(df.where("conv_id = 'c0'").withColumn("dataset", F.lit(None).cast("string")).select(df.columns))
    rows = lambda limit, *tables: {(r.algorithm, r.dataset, r.conv_id): tuple(r) for r in cm.conversation_counts(*tables, ["x", "y"], limit).collect()}
    got = rows(None, hidden(nodes), hidden(gold.union(gold)), hidden(preds))
    assert {k: v for k, v in got.items() if k[1]} == {k: tuple(pytest.approx(x) if isinstance(x, float) else x for x in v) for k, v in rows(0, nodes, gold, preds).items()}
    assert got["x", None, "c0"][3:] == got["x", "d", "c0"][3:] and len(got) == 8

"""Hand-worked chain metrics; grouped and distributed ways; random graphs."""

import random

import pytest

from threadloom.operators import chain_metrics as cm
from threadloom.operators import graph

CASES = {
    # name: gold, pred, P, R, F1, gold paths, pred paths, comp recall, comp precision, M3, n_anc
    "chain": ([[], [0], [1]], [[], [0], [1]], 100, 100, 100, 1, 1, 100, 100, 100, 2),
    "partial": ([[], [0], [], [2], [], [4]], [[], [0], [], [2], [], []], 50, 66.67, 57.14, 3, 4, 66.67, 50, 66.67, 3),
    "no edges": ([[], [0], [1]], [[], [], []], 0, 0, None, 1, 3, 0, 0, 0, 2),
    "diamond": ([[], [0], [], [0], [1, 3]], [[], [0], [], [0], [1, 3]], 100, 100, 100, 3, 3, 100, 100, 100, 3),
    "lost": ([[], [0], [], [0], [1, 3]], [[], [0], [], [0], [3]], 66.67, 66.67, 66.67, 3, 3, 100, 100, 88.89, 3),
    "interleaved": ([[], [], [0], [1]], [[], [0], [1], [2]], 0, 0, None, 2, 1, 0, 0, 41.67, 2),
}


def tables(spark, cases):
    nodes, gold, preds = [], [], []
    for name, (g, p) in cases.items():
        nodes += [("d", name, i) for i in range(len(g))]
        gold += [("d", name, i, x) for i, ps in enumerate(g) for x in ps]
        preds += [("a", "d", name, i, x) for i, ps in enumerate(p) for x in ps]
    key = "dataset string, conv_id string"
    return (
        spark.createDataFrame(nodes, f"{key}, pos long"),
        spark.createDataFrame(gold, f"{key}, child long, parent long"),
        spark.createDataFrame(preds, f"algorithm string, {key}, child long, parent long"),
    )


def near(got, want):
    assert (got is None) == (want is None)
    assert want is None or got == pytest.approx(want, abs=0.006)


@pytest.mark.parametrize("limit", [None, 0])
def test_worked_cases(spark, limit):
    nodes, gold, preds = tables(spark, {k: v[:2] for k, v in CASES.items()})
    rows = {r["conv_id"]: r for r in cm.per_conversation(nodes, gold, preds, ["a"], limit=limit).collect()}
    for name, (_, _, p, r, f1, ng, np_, cr, cp, m3, n_anc) in CASES.items():
        row = rows[name]
        near(row["path_p"], p)
        near(row["path_r"], r)
        near(row["path_f1"], f1)
        assert row["path_f1_zero_filled"] == pytest.approx(f1 or 0.0, abs=0.006)
        assert (row["n_gold_paths"], row["n_pred_paths"], row["n_anc_msgs"]) == (ng, np_, n_anc)
        near(row["component_recall"], cr)
        near(row["component_precision"], cp)
        near(row["ancestor_jaccard"], m3)


def test_path_cap_flags(spark):
    tree = [[]] + [[(i - 1) // 2] for i in range(1, 255)]
    nodes, gold, preds = tables(spark, {"tree": (tree, tree), "small": ([[], [0]], [[], [0]])})
    rows = {r["conv_id"]: r for r in cm.per_conversation(nodes, gold, preds, ["a"], cap=10).collect()}
    assert rows["tree"]["gold_truncated"] and rows["tree"]["pred_truncated"]
    assert rows["tree"]["n_gold_paths"] == 128 and rows["tree"]["path_f1"] == pytest.approx(100)
    assert not rows["small"]["gold_truncated"]
    exactly = cm.per_conversation(nodes, gold, preds, ["a"], cap=128).where("conv_id = 'tree'").first()
    assert exactly["gold_truncated"]


def random_graph(rnd, n, several):
    return [rnd.sample(range(i), min(i, rnd.choice([0, 1, 1, 2 if several else 1]))) for i in range(n)]


def test_both_ways_agree(spark):
    rnd = random.Random(11)
    cases = {f"c{k}": (random_graph(rnd, 40, True), random_graph(rnd, 40, k % 2 == 0)) for k in range(4)}
    cases["long"] = ([[]] + [[i - 1] for i in range(1, 70)], random_graph(rnd, 70, False))
    nodes, gold, preds = tables(spark, cases)
    for op in (graph.components, graph.depth, graph.path_counts):
        a, b = op(nodes, gold), op(nodes, gold, limit=0)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())), op
    a, b = graph.closure(nodes, gold), graph.closure(nodes, gold, limit=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    a = cm.per_conversation(nodes, gold, preds, ["a"]).orderBy("conv_id").collect()
    b = cm.per_conversation(nodes, gold, preds, ["a"], limit=0).orderBy("conv_id").collect()
    for x, y in zip(a, b, strict=True):
        for c in x.asDict():
            assert x[c] == pytest.approx(y[c]) if isinstance(x[c], float) else x[c] == y[c], c


def test_gold_against_itself(spark):
    rnd = random.Random(3)
    g = {f"c{k}": random_graph(rnd, 30, True) for k in range(3)}
    nodes, gold, preds = tables(spark, {k: (v, v) for k, v in g.items()})
    for row in cm.per_conversation(nodes, gold, preds, ["a"]).collect():
        assert row["path_f1"] == pytest.approx(100) and row["component_recall"] == 100
        assert row["ancestor_jaccard"] == pytest.approx(100)


def test_cycles(spark):
    # 1->2->3->1 is a cycle, 0 leads into it, 4->5 ends at 5, 6->6 is its own cycle
    ptr = [(1, 2), (2, 3), (3, 1), (0, 1), (4, 5), (6, 6), (8, 3)]
    df = spark.createDataFrame([("d", "c", a, b) for a, b in ptr], "dataset string, conv_id string, node long, up long")
    assert {r["node"] for r in graph.cyclic(df).collect()} == {0, 1, 2, 3, 6, 8}
    kept = {(r["node"], r["up"]) for r in graph.break_cycles(df).collect()}

    def sequential(pairs):
        pred = dict(pairs)
        for i in sorted(pred):
            seen, cur = set(), i
            while cur in pred:
                if cur in seen:
                    del pred[i]
                    break
                seen.add(cur)
                cur = pred[cur]
        return set(pred.items())

    assert kept == sequential(ptr)
    rnd = random.Random(9)
    ptr = [(i, rnd.randrange(30)) for i in range(1, 30)]
    df = spark.createDataFrame([("d", "c", a, b) for a, b in ptr], "dataset string, conv_id string, node long, up long")
    assert {(r["node"], r["up"]) for r in graph.break_cycles(df).collect()} == sequential(ptr)

"""Listed paths and pooled sets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chain_metrics as cm
from threadloom.operators.paths import climb_sums, distinct_paths, distinct_threads, first_paths, path_steps, register_paths

CONVS = "dataset string, conv_id string"


def graph(rng, n, several=0.3, lone=0.3):
    """Parents of each message."""
    return [sorted(rng.sample(range(i), min(i, 2 if rng.random() < several else 1))) if i and rng.random() > lone else [] for i in range(n)]


def listed(parents, start=()):
    """All paths in order: roots ascending, at each message the largest child first."""
    kids = {}
    for i, ps in enumerate(parents):
        for p in ps:
            kids.setdefault(p, []).append(i)

    def walk(path):
        below = kids.get(path[-1], [])
        return [q for c in sorted(below, reverse=True) for q in walk((*path, c))] if below else [path]

    return [q for r, ps in enumerate(parents) if not ps for q in walk((r,))]


def frames(spark, graphs):
    nodes = [("d", c, i) for c, g in graphs.items() for i in range(len(g))]
    edges = [("d", c, i, p) for c, g in graphs.items() for i, ps in enumerate(g) for p in ps]
    return spark.createDataFrame(nodes, CONVS + ", pos long"), spark.createDataFrame(edges, CONVS + ", child long, parent long")


@pytest.mark.parametrize(("limit", "cap"), [(None, 7), (0, 2000)])
def test_first_paths(spark, limit, cap):
    rng = random.Random(4)
    graphs = {f"c{k}": graph(rng, n, s, lone) for k, (n, s, lone) in enumerate([(1, 0, 0), (12, 0.5, 0.3), (14, 0.9, 0.1), (9, 0, 0.2), (20, 0.4, 0.9)])}
    nodes, edges = frames(spark, graphs)
    junk = spark.createDataFrame([("d", "c1", 2, 2), ("d", "c1", 1, 3), ("d", "c1", 4, -1)], edges.schema)
    got = {}
    for r in first_paths(nodes, edges.union(junk).union(edges.limit(3)), cap=cap, limit=limit).collect():
        got.setdefault(r.conv_id, []).append((r.rank, tuple(r.path), r.n_paths, r.truncated))
    for c, g in graphs.items():
        want = listed(g)
        assert sorted(got[c]) == [(k, p, len(want), len(want) >= cap) for k, p in enumerate(want[:cap])]


def test_first_of_very_many_paths(spark):
    """Sixty diamonds in a row have 2^60 paths; the first ones cost a walk each."""
    parents = [[]]
    for k in range(60):
        top = 3 * k
        parents += [[top], [top], [top + 1, top + 2]]
    nodes, edges = frames(spark, {"c": parents})
    rows = sorted(first_paths(nodes, edges, cap=5).collect(), key=lambda r: r.rank)
    assert len(rows) == 5 and rows[0].n_paths == 2.0**60 and rows[0].truncated
    first = [0, *[p for k in range(60) for p in (3 * k + 2, 3 * k + 3)]]
    assert rows[0].path == first and rows[1].path == [*first[:-2], 178, 180] and len({tuple(r.path) for r in rows}) == 5


def test_table_function_in_sql(spark):
    graphs = {"a": [[], [0], [0], [1, 2]], "b": [[], []]}
    nodes, edges = frames(spark, graphs)
    path_steps(nodes, edges).createOrReplaceTempView("steps_of_test")
    register_paths(spark)
    rows = spark.sql("SELECT * FROM first_paths(TABLE(steps_of_test) PARTITION BY (dataset, conv_id) ORDER BY (node, before), 10)").collect()
    assert sorted((r.rank, tuple(r.path)) for r in rows) == sorted((k, p) for g in graphs.values() for k, p in enumerate(listed(g)))


def pools(seed):
    rng = random.Random(seed)
    base = graph(rng, 10, 0.4, 0.2)
    graphs = {f"c{k}": graph(rng, rng.randrange(1, 9), rng.choice([0, 0.3, 0.8]), rng.choice([0, 0.3])) for k in range(12)}
    graphs |= {"same1": base, "same2": base, "longer": [*base, [9]], "chain": [[], [0], [1], [2]], "chain2": [[], [0], [1]], "cut": base[:7]}
    changed = [list(p) for p in base]
    changed[8] = [0]
    return graphs | {"changed": changed}


@pytest.mark.parametrize("seed", range(2))
def test_distinct_paths(spark, seed):
    graphs = pools(seed)
    nodes, edges = frames(spark, graphs)
    want = len({p for g in graphs.values() for p in listed(g)})
    assert distinct_paths(nodes, edges, ["dataset"], limit=None if seed % 2 else 0).collect()[0].n_paths == want


def test_distinct_paths_of_many_diamonds(spark):
    """2^40 shared paths and one conversation that leaves the others in the middle."""
    parents = [[]]
    for k in range(40):
        top = 3 * k
        parents += [[top], [top], [top + 1, top + 2]]
    other = [list(p) for p in parents]
    other[60] = [59]
    nodes, edges = frames(spark, {"a": parents, "b": parents, "c": other})
    # through the 20th diamond the other conversation has one way where these have two; its loose end 58 is a leaf of its own
    assert distinct_paths(nodes, edges, ["dataset"]).collect()[0].n_paths == 2.0**40 + 2.0**19


def test_sums_of_a_conversation_climb_in_one_task(spark):
    """Every doubling round of all conversations was written and joined before, however small they were."""
    from threadloom.session import intermediates

    rng = random.Random(4)
    up = {(c, x): rng.randrange(max(0, x - 3), x) for c in "ab" for x in range(1, 90) if rng.random() < 0.9}
    edges = spark.createDataFrame([("d", c, x, y) for (c, x), y in up.items()], "dataset string, conv_id string, child long, parent long")
    value = {(c, x): rng.randrange(1000) for c in "ab" for x in range(90)}
    values = spark.createDataFrame([("d", *at, v) for at, v in value.items()], "dataset string, conv_id string, pos long, v long")

    def above(c, x):
        return value[c, x] + (above(c, up[c, x]) if (c, x) in up else 0)

    want = {at: above(*at) for at in value}
    table = lambda *limit: {(r.conv_id, r.pos): r.v for r in climb_sums(edges, values, ["dataset", "conv_id"], ["v"], *limit).collect()}
    with intermediates() as paths:
        assert table() == want
    assert not paths
    assert table(0) == want


def threads(parents):
    comp = list(range(len(parents)))
    for i, ps in enumerate(parents):
        for p in ps:
            a, b = sorted((comp[i], comp[p]))
            comp = [a if c == b else c for c in comp]
    return {frozenset(i for i, c in enumerate(comp) if c == k) for k in set(comp)}


def test_distinct_threads(spark):
    graphs = pools(3)
    nodes, edges = frames(spark, graphs)
    assert distinct_threads(nodes, edges, ["dataset"]).count() == len({t for g in graphs.values() for t in threads(g)})


def test_pooled_sets(spark):
    graphs, rng = pools(9), random.Random(2)
    guess = {c: [[rng.choice(ps)] if ps and rng.random() < 0.8 else [] for ps in g] for c, g in graphs.items()}
    nodes, gold = frames(spark, graphs)
    preds = frames(spark, guess)[1].withColumn("algorithm", F.lit("x"))
    r = cm.pooled_sets(nodes.withColumn("author", F.lit("a")), gold, preds, ["x"]).collect()[0]
    gp, pp = ({p for g in side.values() for p in listed(g)} for side in (graphs, guess))
    gt, pt = ({t for g in side.values() for t in threads(g)} for side in (graphs, guess))
    assert (r.n_gold_paths, r.n_pred_paths, r.n_shared_paths) == (len(gp), len(pp), len(gp & pp))
    assert (r.n_gold_components, r.n_pred_components, r.n_exact) == (len(gt), len(pt), len(gt & pt))


def test_steps_beyond_the_cap_do_not_travel(spark, tmp_path):
    """One message with 40 replies: all of their steps went to the table function of u05_paths before."""
    from threadloom.plans.graphs import u05

    rows = [(k, k, 1 if k == 0 else 100 + k, '{"k": 1}') for k in range(41)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, props string")
    events = events.selectExpr("event_id", "timestamp_seconds(1700000000 + s) AS ts", "user_id", "'click' AS event_type", "CAST(1 AS DOUBLE) AS value", "props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["rank"]: r.path for r in u05(spark, str(tmp_path)).collect()}
    assert got == {k: f"0-{40 - k}" for k in range(25)}
    steps = spark.table("threadloom_steps")
    assert steps.where("before >= 25 AND node <> -1").isEmpty() and steps.count() == 26

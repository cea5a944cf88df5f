"""Thread state before a message: from the forest of merges, and as aggregates over the edges known by then."""

import math
import random

import numpy as np
import pytest

from threadloom.operators.merges import joined_threads, merges, thread_features
from threadloom.operators.threads import centroids, past_threads


def small(spark, seed, n=14):
    rng = random.Random(seed)
    msgs = [("d", f"c{k}", p, rng.choice("xyz")) for k in range(2) for p in range(n)]
    edges = [("d", f"c{k}", p, rng.randrange(p), round(rng.random(), 3)) for k in range(2) for p in range(1, n) if rng.random() < 0.6]
    pairs = [("d", f"c{k}", i, c) for k in range(2) for i in range(n) for c in range(max(0, i - 5), i)]
    frame = lambda rows, cols: spark.createDataFrame(rows, f"dataset string, conv_id string, {cols}")
    return (msgs, frame(msgs, "pos long, author string")), (edges, frame(edges, "child long, parent long, prob double")), (pairs, frame(pairs, "i long, c long"))


def brute(msgs, edges, conv, upto):
    comp = {p: p for _, k, p, _ in msgs if k == conv}
    prob = dict.fromkeys(comp, 0.0)
    for _, k, child, parent, x in edges:
        if k == conv and child < upto:
            a, b = sorted((comp[child], comp[parent]))
            comp = {p: a if c == b else c for p, c in comp.items()}
            prob[child] = max(prob[child], x)
    who = {p: a for _, k, p, a in msgs if k == conv}
    out = {}
    for p, c in comp.items():
        same = [q for q, d in comp.items() if d == c]
        out[p] = (c, len(same), min(same), max(prob[q] for q in same), [who[q] for q in same])
    return out, who


def test_features_and_aggregates_agree_with_brute_force(spark):
    (msgs, m), (edges, e), (pairs, p) = small(spark, 3)
    got = {(r.conv_id, r.i, r.c): r for r in thread_features(m, e, p).collect()}
    assert len(got) == len(pairs)
    for _, conv, i, c in pairs:
        now, who = brute(msgs, edges, conv, i)
        _, size, first, top, people = now[c]
        r = got[conv, i, c]
        assert math.isclose(r.log_size, math.log1p(size)) and math.isclose(r.same_ratio, people.count(who[i]) / size)
        assert math.isclose(r.span, min(100, i - first) / 100) and math.isclose(r.max_prob, top)
    for limit in (None, 0):
        rows = past_threads(m, e, 8, limit).collect()
        for r in rows:
            c, size, first, top, people = brute(msgs, edges, r.conv_id, 8)[0][r.pos]
            assert (r.thread, r.size, r.earliest, r.max_prob, r.n_speakers) == (c, size, first, top, len(set(people)))


def test_centroids_add_up(spark):
    (_, m), (_, e), _ = small(spark, 4)
    vec = m.selectExpr("dataset", "conv_id", "pos", "0 d", "cast(pos as double) x")
    th = past_threads(m, e, 99)
    want = {(r.conv_id, r.thread): r.s for r in th.groupBy("conv_id", "thread").agg({"pos": "sum"}).withColumnRenamed("sum(pos)", "s").collect()}
    assert {(r.conv_id, r.thread): int(r.x) for r in centroids(vec, th).collect()} == want


def several_parents(spark, seed, n, share=0.5):
    """One conversation with several parents a message, junk edges, missing authors and repeated rows."""
    rng = random.Random(seed)
    msgs = [("d", "c", p, rng.choice(["x", "y", "z", None])) for p in range(n)]
    edges = [("d", "c", p, rng.randrange(max(0, p - rng.choice([3, 40, n])), p), round(rng.random(), 3)) for p in range(1, n) for _ in range(rng.choice([0, 1, 1, 3])) if rng.random() < share]
    junk = [("d", "c", 3, 3, 1.0), ("d", "c", 2, 5, 1.0), ("d", "c", 4, -1, 1.0)]
    pairs = [("d", "c", i, c) for i in range(0, n, 3) for c in rng.sample(range(i), min(i, 6))]
    vecs = {p: [rng.gauss(0, 1) for _ in range(3)] for p in range(n) if rng.random() < 0.8}
    frame = lambda rows, cols: spark.createDataFrame(rows, f"dataset string, conv_id string, {cols}")
    frames = (frame(msgs, "pos long, author string"), frame(edges + junk + edges[:5], "child long, parent long, prob double"), frame(pairs + pairs[:5], "i long, c long"))
    vectors = frame([("d", "c", p, v) for p, v in vecs.items()], "pos long, vec array<double>")
    return msgs, edges, pairs, vecs, frames, vectors


@pytest.mark.parametrize(("seed", "n", "rows"), [(1, 80, None), (5, 60, 20)])
def test_all_features(spark, monkeypatch, seed, n, rows):
    """Every feature against its definition; also with groups above the size of a plain window."""
    if rows:
        monkeypatch.setattr("threadloom.operators.ordered.GROUP_ROWS", rows)
        monkeypatch.setattr("threadloom.operators.graph.LOCAL_MSGS", rows)
    msgs, edges, pairs, vecs, (m, e, p), vectors = several_parents(spark, seed, n)
    got = {(r.i, r.c): r for r in thread_features(m, e, p, vectors).collect()}
    assert len(got) == len(set(pairs))
    for _, _, i, c in pairs:
        now, who = brute(msgs, edges, "c", i)
        name, size, first, top, people = now[c]
        r = got[i, c]
        assert math.isclose(r.log_size, math.log1p(size)) and math.isclose(r.span, min(100, i - first) / 100) and math.isclose(r.max_prob, top)
        assert math.isclose(r.same_ratio, people.count(who[i]) / size if who[i] else 0.0) and r.in_thread == (size > 1)
        replies = [x for _, _, x, y, _ in edges if y == c]
        gap = min([i - x for x in replies if x < i], default=100) if replies else i - c
        assert math.isclose(r.reply_gap, math.log1p(gap))
        total = sum((np.array(vecs[q]) for q, s in now.items() if s[0] == name and q in vecs), np.zeros(3))
        mine = np.array(vecs.get(i, [0, 0, 0]))
        assert abs(r.cohesion - total @ mine / (np.linalg.norm(total) * np.linalg.norm(mine) + 1e-9)) < 1e-9


def test_each_thread_ends_once_and_in_a_smaller_one(spark):
    _, _, _, _, (_, e, _), _ = several_parents(spark, 7, 120, 0.9)
    rows = merges(joined_threads(e.where("parent >= 0 and parent < child"))).collect()
    ends = {r.node: r for r in rows}
    assert rows and len(ends) == len(rows) and all(r.up < r.node <= r.at for r in rows)
    assert all(r.at < ends[r.up].at for r in rows if r.up in ends)


def test_no_edges_and_no_pairs(spark):
    _, _, _, _, (m, e, p), _ = several_parents(spark, 1, 10)
    alone = thread_features(m, e.limit(0), p).collect()
    assert alone and all(r.in_thread == 0 and r.max_prob == 0 and math.isclose(r.log_size, math.log(2)) for r in alone)
    assert thread_features(m, e, p.limit(0)).count() == 0


def test_cut_of_each_conversation(spark):
    (msgs, m), (edges, e), _ = small(spark, 6)
    cut = spark.createDataFrame([("d", "c0", 5), ("d", "c1", 12)], "dataset string, conv_id string, upto long")
    for r in past_threads(m, e, cut).collect():
        c, size, first, top, _ = brute(msgs, edges, r.conv_id, 5 if r.conv_id == "c0" else 12)[0][r.pos]
        assert (r.thread, r.size, r.earliest, r.max_prob) == (c, size, first, top)


def test_stretches_of_time_are_replayed(spark, monkeypatch):
    """Threads of parents at the time of each message; a group for every message and part was solved before."""
    import random

    from threadloom.operators import merges as mg
    from threadloom.session import intermediates

    rng = random.Random(4)
    edges = [(c, a, b) for c in "cd" for a in range(1, 260) for b in {rng.randrange(max(0, a - 40), a) for _ in range(rng.randrange(3))}]
    want = set()
    for c in "cd":
        comp = list(range(260))
        for a in range(260):
            parents = [b for x, child, b in edges if x == c and child == a]
            want |= {(c, a, b, comp[b]) for b in parents}
            one = {comp[b] for b in parents} | {a}
            if parents:
                comp = [min(one) if x in one else x for x in comp]
    df = spark.createDataFrame([("d", *e) for e in edges], "dataset string, conv_id string, child long, parent long")
    rows = lambda: {(r.conv_id, r.child, r.parent, r.thread) for r in joined_threads(df).collect()}
    with intermediates() as paths:
        assert rows() == want
    assert not [p for p in paths if "/known-" in p]
    monkeypatch.setattr(mg, "FAN", 4)
    monkeypatch.setattr(mg, "STRETCH", 16)
    assert rows() == want


def test_threads_are_not_broadcast_by_their_file_size(spark):
    """A written table of keys and positions takes a few bytes a row in a file and many in a hash table of the driver."""
    from threadloom.operators.merges import thread_features
    from threadloom.session import materialize

    msgs = spark.range(3000).selectExpr("'d' AS dataset", "'c' AS conv_id", "id AS pos", "CAST(id % 7 AS STRING) AS author")
    edges = msgs.where("pos > 0").selectExpr("dataset", "conv_id", "pos AS child", "pos - 1 - pos % 3 AS parent").where("parent >= 0")
    pairs = edges.selectExpr("dataset", "conv_id", "child AS i", "parent AS c")
    msgs, edges, pairs = (materialize(x) for x in (msgs, edges, pairs))
    names = ["spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold"]
    try:
        spark.conf.set(names[0], "1.0")
        spark.conf.set(names[1], "120k")
        got = thread_features(msgs, edges, pairs)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == pairs.count()
    finally:
        for name in names:
            spark.conf.unset(name)

"""Nodes met along steps: by joins as in one task; rounds for long chains."""

import random

from threadloom.operators import chains

STEPS = "dataset string, conv_id string, pos long, to long"
NODES = "dataset string, conv_id string, pos long"


def plain(seeds, steps):
    met, stack = set(seeds), list(seeds)
    while stack:
        c, x = stack.pop()
        for conv, a, b in steps:
            if (conv, a) == (c, x) and (c, b) not in met:
                met.add((c, b))
                stack.append((c, b))
    return met


def spread(spark, seeds, steps):
    got = chains._spread_reach(
        spark.createDataFrame([("d", *s) for s in seeds], NODES), spark.createDataFrame([("d", *s) for s in steps], STEPS)
    ).collect()
    found = [(r.conv_id, r.pos) for r in got]
    assert len(found) == len(set(found))
    return set(found)


def test_many_graphs(spark):
    rng, seeds, steps = random.Random(9), [], []
    for k in range(60):
        n, c = rng.randrange(2, 14), f"c{k}"
        steps += [(c, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]  # loops, cycles, repeats
        seeds += [(c, rng.randrange(n)) for _ in range(rng.randrange(3))]
    # a cycle without a seed, a chain into a cycle, a seed inside a chain, a tree walked to its root
    steps += [("x", 0, 1), ("x", 1, 0), ("x", 0, 2), *[("y", i, i + 1) for i in range(9)], ("y", 9, 6)]
    steps += [("z", i, (i - 1) // 2) for i in range(1, 31)]
    seeds += [("y", 0), ("y", 4), ("z", 30), ("z", 17), ("alone", 3)]
    assert spread(spark, seeds, steps) == plain(seeds, steps)


def test_no_seed_and_no_step(spark):
    assert spread(spark, [], [("c", 0, 1)]) == set()
    assert spread(spark, [("c", 0), ("c", 0)], []) == {("c", 0)}


def test_rounds_grow_with_the_log_of_a_chain(spark, monkeypatch):
    written, keep = [], chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name: written.append(name) or keep(df, name))
    n = 4_000
    # a spine of n messages with a leaf on each: down from its start, up from its end
    down = [("down", i, i + 1) for i in range(n)] + [("down", i, 10_000 + i) for i in range(n)]
    up = [("up", i + 1, i) for i in range(n)] + [("up", 10_000 + i, i) for i in range(n)]
    met = spread(spark, [("down", 0), ("up", n)], down + up)
    assert met == {("down", i) for i in range(n + 1)} | {("down", 10_000 + i) for i in range(n)} | {("up", i) for i in range(n + 1)}
    assert written.count("steps") <= 16


def test_many_graphs_in_short_stretches(spark, monkeypatch):
    rng, seeds, steps = random.Random(4), [], []
    for k in range(120):
        n, c, w = rng.randrange(2, 40), f"c{k}", rng.choice([2, 4, 40])
        for _ in range(rng.randrange(1, 2 * n)):  # near and far, loops, cycles, repeats
            a = rng.randrange(n)
            steps.append((c, a, min(n - 1, max(0, a + rng.randrange(-w, w + 1)))))
        seeds += [(c, rng.randrange(n)) for _ in range(rng.randrange(3))]
    # chains both ways over many stretches, one with a ladder, one that a seed cuts
    steps += [("up", i, i - 1) for i in range(1, 60)] + [("down", i, i + 1) for i in range(59)]
    steps += [("ladder", i, i - d) for i in range(2, 60) for d in (1, 2)]
    seeds += [("up", 41), ("down", 7), ("down", 30), ("ladder", 50), ("alone", 3)]
    want = plain(seeds, steps)
    for size in (1, 5):
        monkeypatch.setattr(chains, "STRETCH", size)
        assert spread(spark, seeds, steps) == want


def test_rounds_carry_the_borders_of_stretches_only(spark, monkeypatch):
    rows, keep = [], chains.materialize

    def count(df, name):
        out = keep(df, name)
        rows.append(out.count() if name in ("steps", "cross", "bridges") else 0)
        return out

    monkeypatch.setattr(chains, "materialize", count)
    monkeypatch.setattr(chains, "STRETCH", 500, raising=False)
    n = 20_000
    steps = [("c", i + 1, i) for i in range(n)] + [("c", i + 2, i) for i in range(0, n, 7)]
    assert spread(spark, [("c", 15_000)], steps) == plain_chain(15_000, steps)
    assert sum(rows) < n // 10


def plain_chain(seed, steps):
    onward, met, stack = {}, {seed}, [seed]
    for _, a, b in steps:
        onward.setdefault(a, []).append(b)
    while stack:
        for x in onward.get(stack.pop(), []):
            if x not in met:
                met.add(x)
                stack.append(x)
    return {("c", x) for x in met}

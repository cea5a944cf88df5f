"""The 77 pair features against a direct computation, message by message."""

import random

from threadloom.operators.pair_vector import features77

SCHEMA = "dataset string, conv_id string, pos long, author string, minute long, is_system boolean, is_bot boolean, targets array<string>, text string"


def within(x, edges):
    return [a <= x < b for a, b in zip(edges, edges[1:])]


def apart(rows, a, b):
    if a is None or b is None:
        return -1
    x, y = rows[min(a, b)]["minute"], rows[max(a, b)]["minute"]
    return y - x + (1440 if y // 60 < x // 60 else 0)


def expected(name, rows, i, c):
    n = len(rows)
    who = [r["author"] for r in rows]
    before = lambda k: next((j for j in range(k - 1, -1, -1) if who[j] == who[k] and not rows[j]["is_system"]), None)
    after = lambda k: next((j for j in range(k + 1, n) if who[j] == who[k] and not rows[j]["is_system"]), None)
    timed = [k for k in range(n) if not rows[k]["is_system"]]
    end = timed[-1] - 1 if timed and timed[-1] >= 1 else None
    f = [str(y) in name for y in range(2004, 2018)]
    f += within(n / max(1, apart(rows, timed[0] if timed else None, end)), (-1, 1, 3, 10, 10000))

    def own(k):
        last = before(k)
        return [
            bool(rows[k]["targets"]), last is not None, last is not None and bool(rows[last]["targets"]),
            *within(-1 if last is None else k - last, (-1, 0, 1, 5, 20, 1000)), *within(apart(rows, last, k), (-1, 0, 2, 10, 10000)),
        ]

    other = i != c
    f += [rows[i]["is_system"], rows[i]["minute"] // 60 / 24, *own(i), rows[i]["is_bot"]]
    f += [rows[c]["is_system"], rows[c]["minute"] // 60 / 24, *[other and x for x in own(c)], rows[c]["is_bot"]]
    f += [other and c + 1 < n and who[c] == who[c + 1], other and c - 1 > 0 and who[c] == who[c - 1]]
    t = apart(rows, c, i)
    f += [not other, min(100, i - c) / 100, i - c > 1, min(100, t) / 100, *within(t, (-1, 0, 1, 5, 60, 10000))]
    qt, lt = set(rows[i]["targets"]), set(rows[c]["targets"])
    f += [who[i].lower() in lt, who[c].lower() in qt]
    f += [other and (before(i) is None or before(i) < c), other and (after(c) is None or after(c) > i)]
    for a, b in ((i, c), (c, i)):
        told = [k for k in range(n) if who[k] == who[a] and who[b] in rows[k]["targets"]]
        f += [bool(other and told and min(told) < c), bool(other and told and max(told) > i), other and any(c < k < i for k in told)]
    f += [who[i] == who[c], other and bool(qt & lt)]
    qw, lw = set(rows[i]["text"].split()), set(rows[c]["text"].split())
    k = len(qw & lw)
    f += [k / len(lw), k / len(qw)] if other and qw and lw else [0, 0]
    f += [other and k == 0, other and k == 1, other and k > 1, other and k > 5]
    return [float(x) for x in f]


def test_features(spark):
    rng = random.Random(11)
    data, logs = [], {"log-2008-a": 40, "log-b": 1, "log-2016": 12}
    for name, n in logs.items():
        minute, rows = 1380, []
        for pos in range(n):
            minute = (minute + rng.choice([0, 0, 1, 4, 70])) % 1440
            names = ["ann", "bob", "Cat", "bot"]
            rows.append(dict(author=rng.choice(names), minute=minute, is_system=rng.random() < 0.15, is_bot=False, targets=rng.sample(["ann", "bob", "cat"], rng.randrange(3)), text=" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))))
            rows[-1]["is_bot"] = rows[-1]["author"] == "bot"
        logs[name] = rows
        data += [("d", name, p, *(r[k] for k in ("author", "minute", "is_system", "is_bot", "targets", "text"))) for p, r in enumerate(rows)]
    got = features77(spark.createDataFrame(data, SCHEMA), 15).collect()
    assert len(got) == sum(min(p, 15) + 1 for rows in logs.values() for p in range(len(rows)))
    for r in got:
        want = expected(r.conv_id, logs[r.conv_id], r.i, r.c)
        assert len(r.features) == len(want) == 77
        bad = [(k, a, b) for k, (a, b) in enumerate(zip(r.features, want)) if abs(a - b) > 1e-9]
        assert not bad, (r.conv_id, r.i, r.c, bad)


def test_means_are_taken_where_pairs_are_made(spark):
    """Every pair became 77 rows before."""
    from pyspark.sql import functions as F

    from threadloom.operators import pairs
    from threadloom.operators.pair_vector import feature_means, features77

    rows = [("d" if c == "x" else "e", c, p, f"a{p * 7 % 5}", p * 3 % 1440, p % 11 == 0, p % 5 == 4, [f"a{p % 4}"] if p % 3 else [], f"w{p % 6} w{p % 4} of") for c in "xy" for p in range(140)]
    msgs = spark.createDataFrame(rows, "dataset string, conv_id string, pos long, author string, minute long, is_system boolean, is_bot boolean, targets array<string>, text string")
    gold = spark.createDataFrame([(d, c, p, p - 1 - p % 4) for d, c in (("d", "x"), ("e", "y")) for p in range(5, 140, 3)], "dataset string, conv_id string, child long, parent long")
    got = feature_means(msgs, gold)
    assert not any("Generate posexplode(features" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    listed = pairs.label(features77(msgs, gold=gold), gold).select("dataset", "label", F.posexplode("features").alias("feature", "x"))
    want = listed.groupBy("dataset", "label", "feature").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()
    assert {(r.dataset, r.label, r.feature): (r.n_pairs, round(r["mean"], 9)) for r in got.collect()} == {(r.dataset, r.label, r.feature): (r.n, round(r.m, 9)) for r in want}

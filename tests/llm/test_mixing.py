"""op3: targets, exact word counts, positions."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm.mixing import curriculum
from threadloom.llm.queries import cyclic_schedules


def shared_out(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), "abcde"[min(i % 9, 4)]) for i in range(400)] + [(400 + i, "x y", None) for i in range(5)]
    msgs = spark.createDataFrame(rows, "msg_id long, text string, dataset string")
    plan = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0, 2.0]), ("c", [1.0, 1.0]), ("d", [6.0, 6.0]), (None, [50.0, 50.0])], "dataset string, weights array<double>")
    return rows, curriculum(msgs, plan).collect()


def test_targets_and_taken(mixed):
    rows, got = mixed
    sizes = defaultdict(int)
    for _, text, s in rows:
        sizes[s] += len(text.split())
    want = shared_out(sizes, {"a": 0.5, "b": 1.5, "c": 1.0, "d": 6.0, "e": 1.0, None: 50.0})
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r.target, want[r.dataset]) and r.dataset_size == sizes[r.dataset]
        assert r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        taken[r.dataset] += r.taken
    assert {s: math.floor(t + 1e-9) for s, t in want.items()} == dict(taken)
    assert want[None] == 3 * sizes[None]


def test_positions_follow_the_schedules(mixed):
    _, got = mixed
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    assert all(r.position is None for r in got[len(at) :])
    # words of dataset a, whose weight falls from 1 to 0: three quarters come in the first half
    words = [(c.position, c.words) for r in got if r.dataset == "a" for c in r.copies]
    early = sum(w for p, w in words if p < 0.5)
    assert abs(early / sum(w for _, w in words) - 0.75) < 0.1
    words = [(c.position, c.words) for r in got if r.dataset == "b" for c in r.copies]
    assert abs(sum(w for p, w in words if p < 0.5) / sum(w for _, w in words) - 1 / 3) < 0.1


def test_reruns_agree(spark, odd):
    plan = cyclic_schedules(odd)
    cols = ["msg_id", "dataset", "size", "taken", "position"]
    a, b = (sorted(map(str, curriculum(df, plan).select(*cols).collect())) for df in (odd, odd.repartition(5)))
    assert a == b


def test_odd_rows(odd, nothing):
    got = curriculum(odd.withColumnRenamed("author", "size"), cyclic_schedules(odd)).collect()
    assert len(got) == 13
    by = {r.msg_id: r for r in got}
    assert by[2].size == by[3].size == by[4].size == by[2].taken == 0 and by[2].position is None
    assert by[None].size == 10
    assert curriculum(nothing, cyclic_schedules(nothing)).collect() == []
    none = curriculum(odd.where(F.col("msg_id").isin(2, 3)), cyclic_schedules(odd)).collect()
    assert [r.target for r in none] == [0.0, 0.0]

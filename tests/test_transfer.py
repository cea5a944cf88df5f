"""Ranks and decodings of pairs that stay where they are made."""

import random

from pyspark.sql import functions as F

from threadloom.operators import decode
from threadloom.plans.models import ecdf_rank

PAIRS = "dataset string, conv_id string, _blk long, i long, c long, a double, b double"


def test_ranks_come_to_the_rows(spark):
    """Every target row was sorted and dealt by value before."""
    rng = random.Random(6)
    draw = lambda n: [(k, rng.choice([None, rng.randrange(40) / 4])) for k in range(n)]
    target, source = (spark.createDataFrame(draw(n), "k long, x double") for n in (300, 90))
    known = [r.x for r in source.collect() if r.x is not None]
    want = {r.k: sum(y <= r.x for y in known) / len(known) if r.x is not None else 0.0 for r in target.collect()}
    near = ecdf_rank(target, source, "x", ["k"])
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    for got in (near, ecdf_rank(target, source, "x", ["k"], limit=0)):
        assert {r.k: r.x_rank for r in got.collect()} == want
    none = ecdf_rank(target, source.where("x > 100"), "x", ["k"]).collect()
    assert {r.x_rank for r in none} == {None, 0.0}


def test_one_decoding_of_several_scores(spark):
    """The pairs were made and ranked once for each score before."""
    rng = random.Random(2)
    rows = [("d", v, i // 8, i, c, rng.randrange(8) / 10, rng.randrange(5) / 10) for v in "xy" for i in range(1, 30) for c in range(max(0, i - 6), i)]
    pairs = spark.createDataFrame(rows, PAIRS)
    got = decode.thresholds(pairs, {"n1": "a", "n2": "b"}).collect()
    assert len(got) == len({(r.conv_id, r.child, r.parent) for r in got})
    for name, col in (("n1", "a"), ("n2", "b")):
        want = decode.threshold(pairs.withColumn("score", F.col(col))).collect()
        assert sorted((r.conv_id, r.child, r.parent) for r in got if name in r.names) == sorted((r.conv_id, r.child, r.parent) for r in want)

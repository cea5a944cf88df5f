"""Pair scorers that draw and decode without making the pairs, next to those that make them."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import decode, pairs
from threadloom.plans.models import score, weights

COLS = ["author", "ts_us", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["d", "e"]) if p == -1 else "d", c, p, rng.choice(["a", "b", "", None]), rng.choice([None, 10**6 * (p + rng.randrange(9))]), rng.randrange(30)) for c in "xyz" for p in range(330)]
    msgs = spark.createDataFrame(rows, "dataset string, conv_id string, pos long, author string, ts_us long, n_chars int")
    gold = [("d", c, p, q) for c in "xy" for p in range(1, 330, 2) for q in {rng.randrange(max(0, p - 130), p) for _ in range(2)}]
    return msgs, spark.createDataFrame(gold, "dataset string, conv_id string, child long, parent long")


@pytest.fixture
def made(tables):
    msgs, gold = tables
    return pairs.label(pairs.features(pairs.candidates(msgs, COLS, COLS, gold=gold)), gold)


def test_the_same_rows_are_drawn(tables, made, monkeypatch):
    """All pairs were made, hashed and sorted before."""
    monkeypatch.setattr(pairs, "STRETCH", 128)
    got = pairs.features(pairs.sampled(*tables, COLS, k=4))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    cols = [*pairs.PAIR, "c", "label", *pairs.FEATURES]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, decode.sample_negatives(made, k=4).select(cols).collect()))


class Model:
    def __init__(self, coefficients, intercept):
        self.coefficients, self.intercept = coefficients, intercept


MODELS = {"n": Model([1.5, -0.7, -0.1, 0.2, 0.05, 0.3], 0.4), "o": Model([0.1, 0.2, 0.1, -0.5, 0.3, -0.2], -2.5)}


@pytest.mark.parametrize("only", [None, "which"])
def test_the_same_edges_are_decoded(tables, made, monkeypatch, only):
    """Each model had its own pass over all pairs, which were sorted by score, before."""
    monkeypatch.setattr(pairs, "STRETCH", 128)
    msgs, gold = tables
    which = F.when(F.col("conv_id") == "x", "n").otherwise("o")
    got = pairs.decoded(msgs.withColumn("which", which), gold, {n: weights(m) for n, m in MODELS.items()}, only=only)
    got = sorted((r.name, r.conv_id, r.child, r.parent) for r in got.collect())
    want = []
    for name, model in MODELS.items():
        rows = made if only is None else made.where(which == name)
        want += [(name, r.conv_id, r.child, r.parent) for r in decode.threshold(score(model, rows, pairs.FEATURES)).collect()]
    assert got == sorted(want) and len(got) > 300


def test_scores_are_those_of_the_model(spark, made):
    """The pairs became vectors and went through the model's functions before."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from threadloom.plans.models import fit

    model = fit(made, pairs.FEATURES)
    rows = model.transform(VectorAssembler(inputCols=pairs.FEATURES, outputCol="features").transform(score(model, made, pairs.FEATURES)))
    off = rows.select(F.max(F.abs(F.col("score") - vector_to_array("probability")[1]))).first()[0]
    assert off < 1e-12
    assert "UDF" not in score(model, made, pairs.FEATURES)._jdf.queryExecution().optimizedPlan().toString()

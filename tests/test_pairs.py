"""Pair tables: never dealt anew after they are made, whatever is asked of them."""

import pytest

from threadloom.operators import chains, decode, pairs
from threadloom.operators.pair_vector import features77


@pytest.fixture(scope="module")
def rows(spark):
    msgs = [("d", f"c{k}", p, f"a{(p * 7 + k) % 5}", [f"a{p % 3}"]) for k in range(2) for p in range(300)]
    gold = [("d", f"c{k}", p, p - 1 - p % 4) for k in range(2) for p in range(5, 300, 3)]
    return (
        spark.createDataFrame(msgs, "dataset string, conv_id string, pos long, author string, mentions array<string>"),
        spark.createDataFrame(gold, "dataset string, conv_id string, child long, parent long"),
    )


def exchanges_of_pairs(df) -> int:
    """Exchanges above the join that makes the pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    made = next(k for k, x in enumerate(lines) if "ShuffledHashJoin" in x and "_blk" in x)
    return sum("Exchange" in x and "SinglePartition" not in x for x in lines[:made])


def test_labels_and_ranks_stay_in_place(rows):
    msgs, gold = rows
    labelled = pairs.label(pairs.candidates(msgs, gold=gold), gold)
    assert exchanges_of_pairs(labelled) == 0
    assert exchanges_of_pairs(decode.sample_negatives(labelled)) == 0
    assert exchanges_of_pairs(decode.threshold(pairs.scored(msgs), 0.25)) == 0
    p = pairs.scored(msgs).selectExpr("*", "score as prob", "(c % 4) / 4.0 as complete")
    assert exchanges_of_pairs(decode.challengers(p, ["prob", "complete"])) == 0


def test_gold_before_or_after(rows):
    msgs, gold = rows
    early = pairs.label(pairs.candidates(msgs, ["author"], gold=gold), gold)
    late = pairs.label(pairs.candidates(msgs, ["author"]), gold)
    assert sorted(early.collect()) == sorted(late.select(early.columns).collect())


def test_only_children_with_gold(rows):
    msgs, gold = rows
    cols = "dataset, conv_id, pos, author, pos % 1440 as minute, pos % 11 = 0 as is_system, false as is_bot, mentions as targets, concat('w', pos % 6, ' x') as text"
    msgs = msgs.selectExpr(*cols.split(", ", 8)[:8], "concat('w', pos % 6, ' x') as text")
    few = features77(msgs, 15, gold).drop("_gold")
    every = features77(msgs, 15).join(gold.selectExpr("dataset", "conv_id", "child as i").distinct(), ["dataset", "conv_id", "i"], "left_semi")
    assert sorted(few.collect()) == sorted(every.select(few.columns).collect())


def test_prune_writes_few_pairs(rows, monkeypatch):
    msgs, _ = rows
    sizes = []
    real = chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name="step": sizes.append((name, real(df, name))) or sizes[-1][1])
    chains.anchor_prune(msgs.select("dataset", "conv_id", "pos"), pairs.scored(msgs)).collect()
    assert dict(sizes)["scored"].count() <= 3 * msgs.count()


def test_texts_meet_messages_where_these_lie(spark, monkeypatch):
    """Sums of a message and a text travelled before."""
    import re

    from pyspark.sql import functions as F

    from threadloom.operators import locate as lo

    monkeypatch.setattr(lo, "PART_SUMS", 10)
    said = [("d", f"c{k % 3}", k // 3, "ann", f"the word{k} is w{k % 5}") for k in range(30)]
    msgs = spark.createDataFrame(said, "dataset string, conv_id string, pos long, author string, text string")
    texts = spark.createDataFrame([(k, f"the word{k}") for k in range(4)], "query_id long, text string")
    got = lo.locate(msgs, texts, F.lit(True), k=1, min_sim=0.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, dataset", plan)
    assert {(r.query_id, r.conv_id, r.pos) for r in got.collect()} == {(k, f"c{k % 3}", k // 3) for k in range(4)}

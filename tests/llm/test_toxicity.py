"""op9: segments against brute force, held-out results, odd rows."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import toxicity


def brute(scores):
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((total[j] - total[i], i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, i, j = best
    return brute(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(scores[j:])]


@given(st.integers(0, 10**6), st.integers(0, 25))
@settings(max_examples=150, deadline=None)
def test_segments(seed, n):
    rng = random.Random(seed)
    scores = [rng.random() * 2 if rng.random() < 0.5 else -0.7 for _ in range(n)]
    place = np.array([k for k, s in enumerate(scores) if s > 0], np.int64)
    got = toxicity.segments(place, np.array([s for s in scores if s > 0]), 0.7)
    want = brute(scores)
    assert [(a, b) for a, b, _ in got] == want
    assert np.allclose([s for *_, s in got], [sum(scores[a:b]) for a, b in want])


def texts(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) * toxic):
            words[rng.randrange(len(words))] = rng.choice(["Nasty!", "vile", "horrid,"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = texts(1, 900)
    msgs = spark.createDataFrame(rows, "msg_id long, text string")
    model = toxicity.toxicity_model(msgs, spark.createDataFrame(labels[:600], "msg_id long, toxic int"))
    got = {r.msg_id: r for r in toxicity.score_toxicity(msgs, model).collect()}
    right = [got[k].predicted == y for k, y in labels[600:]]
    assert np.mean(right) > 0.97
    hit = next(r for k, y in labels[600:] if y for r in [got[k]] if r.passages)
    words = rows[hit.msg_id][1].split()
    assert any(any(w.strip("!,").lower() in ("nasty", "vile", "horrid") for w in words[p.start : p.stop]) for p in hit.passages)


def test_sample_is_bounded_and_one_row_an_id(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), *((k, 0) for k in range(10, 60))], "msg_id long, toxic int")
    assert toxicity.sample_labels(labels, 20).count() == 20
    assert {r.msg_id: r.toxic for r in toxicity.sample_labels(labels).collect()}[1] == 1


def test_words_are_letters():
    row, bucket = toxicity.word_buckets(pa.chunked_array([["Bad.bad%%%BAD", None, "", "12 é"]]))
    assert row.tolist() == [0, 0, 0, 3] and len(set(bucket[:3].tolist())) == 1


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "msg_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (7, 0), (6, 0)], "msg_id long, toxic int")):
        model = toxicity.toxicity_model(odd, labels)
        got = toxicity.score_toxicity(odd, model).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.msg_id in (2, 3, 4)}) == 1
        assert toxicity.score_toxicity(nothing, model).collect() == []
    assert toxicity.score_toxicity(nothing, toxicity.toxicity_model(nothing, none)).collect() == []


def test_without_labels_nothing_is_toxic(spark, odd):
    msgs = spark.createDataFrame(texts(3, 60)[0], "msg_id long, text string").unionByName(odd.select("msg_id", "text"))
    none = spark.createDataFrame([], "msg_id long, toxic int")
    clean = spark.createDataFrame([(k, 0) for k in range(40)], "msg_id long, toxic int")
    for labels, score in ((none, 0.05), (clean, None)):
        got = toxicity.score_toxicity(msgs, toxicity.toxicity_model(msgs, labels)).collect()
        assert not any(r.predicted for r in got) and len({round(r.score, 9) for r in got}) == 1
        assert score is None or abs(got[0].score - score) < 1e-9

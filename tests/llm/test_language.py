"""op1: held-out accuracy, mixtures, odd rows."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language
from threadloom.llm.queries import documents, op1

EN = "the cat sat on the mat and then the dog came with this thing that was there "
DE = "der hund und die katze sind nicht mit dem schönen tisch aber auch wenig über "
FR = "le chat est sur la table et les autres sont dans une maison avec beaucoup de "


def model_of(spark):
    rows = [(lang, text * 20) for lang, text in (("en", EN), ("de", DE), ("fr", FR))]
    return language.language_model(spark.createDataFrame([*rows, (None, "x y z"), ("en", None)], "lang string, text string"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = documents(spark, sf).select(F.col("msg_id").alias("doc_id"), "lang")
    got = op1(spark, sf).join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_cover_all_rows_and_merge(spark):
    df = spark.createDataFrame([("en", EN)] * 6 + [("de", DE)] * 3, "lang string, text string")
    a = {(r.lang, r.gram): r.n for r in language.gram_counts(df.repartition(4)).collect()}
    assert a == {(r.lang, r.gram): r.n for r in language.gram_counts(df.coalesce(1)).collect()}
    _, bucket = language.grams([EN])
    assert sum(n for (lang, _), n in a.items() if lang == "en") == 6 * len(bucket)


def test_mixtures(spark):
    model = model_of(spark)
    full, chosen = language.mixtures([EN * 6 + DE * 3, EN * 3, FR, "", None, "123 !!"], model)
    de, en, fr = (model["langs"].index(x) for x in ("de", "en", "fr"))
    assert abs(chosen[0][en] - 2 / 3) < 0.15 and abs(chosen[0][de] - 1 / 3) < 0.15 and chosen[0][fr] == 0
    assert chosen[1].tolist() == [float(k == en) for k in range(3)] and chosen[2][fr] == 1
    assert not full[3:].any() and not chosen[3:].any()
    # what stands beside a text does not change it
    assert np.allclose(language.mixtures([FR], model)[0][0], full[2])


def test_odd_rows(spark, odd, nothing):
    model = model_of(spark)
    got = language.identify_languages(odd, model).collect()
    by = {r.msg_id: r for r in got}
    assert len(got) == 13 and "lang_mix" in got[0]
    for k in (2, 3, 4, 10):
        assert (by[k].lang_pred, by[k].score, by[k].lang_mix) == ("und", 0.0, [])
    assert by[1].lang_pred == "en" and isinstance(by[1].score, float) and by[1].lang == "en"
    assert by[9].lang_pred in model["langs"]
    assert language.identify_languages(nothing, model).collect() == []
    empty = language.language_model(nothing)
    assert empty["langs"] == [] and {r.lang_pred for r in language.identify_languages(odd, empty).collect()} == {"und"}


def plain_mixture(text, model):
    """The selected proportions of one text, one segment and one language at a time."""
    _, bucket = language.grams([text])
    wide, step = len(model["langs"]), language.SEGMENT
    segments = [[sum(float(model["log"][b][k]) for b in bucket[a : a + step]) for k in range(wide)] for a in range(0, len(bucket), step)]

    def fit(allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        likes = [{k: math.exp(s[k] - max(s[j] for j in allowed)) for k in allowed} for s in segments]
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for like in likes:
                whole = sum(share[k] * like[k] for k in allowed)
                for k in allowed:
                    new[k] += share[k] * like[k] / whole / len(segments)
            share = {k: max(v, 1e-12) for k, v in new.items()}
        value = sum(math.log(sum(share[k] * like[k] for k in allowed)) + max(s[k] for k in allowed) for like, s in zip(likes, segments, strict=True))
        return share, value

    full, _ = fit(list(range(wide)))
    order = sorted(full, key=lambda k: (-full[k], k))
    best, top = None, -math.inf
    for size in range(1, wide + 1):
        share, value = fit(sorted(order[:size]))
        value -= language.PENALTY * math.log(len(segments) + 1) * size
        if value <= top:
            break
        best, top = share, value
    return [full[k] for k in range(wide)], [best.get(k, 0.0) for k in range(wide)]


@pytest.mark.parametrize("cells", [1 << 22, 60])
def test_mixtures_equal_plain_expectation_maximisation(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "CELLS", cells)
    model = model_of(spark)
    rng = random.Random(5)
    texts = ["".join(rng.choice([EN, DE, FR]) for _ in range(n)) for n in (1, 2, 5, 9)] + [EN[:30], "ab", "q x"]
    got = [language.mixtures(some, model) for some in language.grouped(texts, 3)]
    full, chosen = (np.concatenate(x) for x in zip(*got, strict=True))
    assert (len(got) == 1) == (cells > 60)
    for text, f, c in zip(texts, full, chosen, strict=True):
        if not len(language.grams([text])[0]):
            assert not f.any() and not c.any()
            continue
        want = plain_mixture(text, model)
        assert np.allclose(f, want[0], atol=1e-4) and np.allclose(c, want[1], atol=1e-4)


def test_memory_does_not_grow_with_the_labels():
    rng = np.random.default_rng(3)
    text, peaks = [(EN + DE + FR) * 40] * 100, []
    for wide in (50, 200):
        model = {"langs": [f"l{k:03d}" for k in range(wide)], "log": np.log(rng.random((1 << language.BITS, wide), np.float32) + 1e-3)}
        tracemalloc.start()
        try:
            for some in language.grouped(text, wide):
                language.mixtures(some, model)
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert max(peaks) < 400_000_000

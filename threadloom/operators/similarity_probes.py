"""Parent predictors that compare texts or vectors, registered next to the positional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.functions.vectors import with_hash_vector
from threadloom.operators import decode, pairs
from threadloom.operators.probes import register_probe
from threadloom.schema import CONV, WINDOW


@register_probe("simmax")
def simmax(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """The message in the window with the largest dot product; texts are hashed to vectors if there is no ``vec``."""
    rows = msgs if "vec" in msgs.columns else with_hash_vector(msgs)
    return pairs.most_similar(rows, w).select(*CONV, "child", "parent")


@register_probe("b4_tfidf")
def b4_tfidf(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """The best tf-idf cosine after decay with distance; a self link if none is good enough."""
    weights = pairs.weigh(msgs, pairs.fit_idf(msgs), [*CONV, "pos"])
    return decode.cosine_decay(pairs.shared_words(weights, w), msgs)


@register_probe("b5_features", style="1tom")
def b5_features(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """One or two candidates of the hand-weighted score."""
    return decode.one_or_two(pairs.feature_scores(msgs, pairs.fit_idf(msgs), w), msgs)

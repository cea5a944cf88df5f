"""Find the messages most similar to given texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.pairs import fit_idf, weigh
from threadloom.schema import CONV

#: Sums of a message and a text in one task: a common word brings all of them together.
PART_SUMS = 1_000_000


def locate(msgs: DataFrame, texts: DataFrame, usable: Column, k: int = 10, min_sim: float = 0.15) -> DataFrame:
    """(query_id, message key, similarity, rank): the ``k`` best messages per text by tf-idf cosine.

    A text meets a message once per shared word and is summed up where the messages lie, dealt so that
    a task sums up at most about ``PART_SUMS`` meetings; each text's list is limited before the exchange.
    """
    idf = fit_idf(msgs)
    docs = weigh(msgs, idf, [*CONV, "pos"])
    asked = weigh(texts, idf, ["query_id"]).withColumnsRenamed({"weight": "qw", "norm": "qn"})
    searched = docs.join(msgs.where(usable).select(*CONV, "pos"), [*CONV, "pos"], "left_semi")
    searched = searched.repartition(max(1, -(-msgs.count() * texts.count() // PART_SUMS)), *CONV, "pos")
    met = searched.join(asked, "word").groupBy("query_id", *CONV, "pos").agg(
        (F.sum(F.col("weight") * F.col("qw")) / (F.first("norm") * F.first("qn"))).alias("similarity")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "conv_id", "pos")
    hits = met.where(F.col("similarity") > min_sim).withColumn("rank", F.row_number().over(w))
    return hits.where(F.col("rank") <= k).select("query_id", *CONV, "pos", "similarity", F.col("rank").cast("long").alias("rank"))

"""Threads as they stood before a given message: components over the edges known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import components
from threadloom.schema import CONV


def past_threads(msgs: DataFrame, edges: DataFrame, upto: int | DataFrame, limit: int | None = None) -> DataFrame:
    """(conversation, pos, thread, size, earliest, max_prob, n_speakers) over edges of messages before ``upto``.

    ``upto`` is a position, or a table (conversation, upto) of them; conversations without one know no edge.
    ``edges`` may carry ``prob`` (1 without it); ``thread`` is the smallest position in it.  Every
    message is a thread of its own until an edge joins it; the figures are aggregated by thread, so
    no conversation is gathered.  Messages without an author count no speaker.
    """
    prob = F.col("prob") if "prob" in edges.columns else F.lit(1.0)
    cut = F.lit(upto) if isinstance(upto, int) else F.col("upto")
    timed = edges if isinstance(upto, int) else edges.join(upto.select(*CONV, "upto"), CONV)
    known = timed.where((F.col("child") < cut) & (F.col("parent") < F.col("child"))).select(*CONV, "child", "parent", prob.alias("prob"))
    comp = components(msgs, known.select(*CONV, "child", "parent").distinct(), limit=limit).withColumnRenamed("comp", "thread")
    best = known.groupBy(*CONV, F.col("child").alias("pos")).agg(F.max("prob").alias("prob"))
    rows = msgs.select(*CONV, "pos", "author").join(comp, [*CONV, "pos"]).join(best, [*CONV, "pos"], "left")
    stats = rows.groupBy(*CONV, "thread").agg(
        F.count("*").alias("size"), F.min("pos").alias("earliest"), F.coalesce(F.max("prob"), F.lit(0.0)).alias("max_prob"),
        F.countDistinct(F.nullif("author", F.lit(""))).alias("n_speakers"),
    )
    return comp.join(stats, [*CONV, "thread"]).select(*CONV, "pos", "thread", "size", "earliest", "max_prob", "n_speakers")


def centroids(vectors: DataFrame, threads: DataFrame) -> DataFrame:
    """(conversation, thread, d, x): sum of the message vectors (conversation, pos, d, x) of each thread."""
    return vectors.join(threads.select(*CONV, "pos", "thread"), [*CONV, "pos"]).groupBy(*CONV, "thread", "d").agg(F.sum("x").alias("x"))

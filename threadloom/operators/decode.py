"""From scored pairs to predicted edges.

Scored pairs carry (dataset, conv_id, _blk, i, c, score) or the score columns a decoder names.
All ranking happens per message, that is over at most one window of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.pairs import DECAY, MIN_COSINE, PAIR, SECOND_MARGIN, SECOND_MIN, WEIGHTS
from threadloom.schema import CONV, WINDOW


def per_child(*order: Column):
    return Window.partitionBy(*PAIR).orderBy(*order)


def ranked(pairs: DataFrame, score: str = "score", ties: str = "oldest") -> DataFrame:
    """Attach ``rank`` (1 = best).  Ties go to the oldest or to the nearest candidate."""
    tie = F.col("c") if ties == "oldest" else F.desc("c")
    return pairs.withColumn("rank", F.row_number().over(per_child(F.desc(score), tie)))


def edges_out(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*CONV, F.col("i").alias("child"), F.col("c").alias("parent"), *extra)


def best(pairs: DataFrame, score: str = "score", ties: str = "oldest") -> DataFrame:
    """The best candidate per message by a map-side-combined maximum."""
    pos = -F.col("c") if ties == "oldest" else F.col("c")
    top = pairs.groupBy(*PAIR).agg(F.max_by("c", F.struct(F.col(score), pos)).alias("c"), F.max(score).alias(score))
    return top


def threshold(pairs: DataFrame, tau: float = 0.5, cap: int | None = None) -> DataFrame:
    """Every candidate with score >= tau (the ``cap`` best of them), or the best one if none is."""
    r = ranked(pairs)
    keep = F.col("score") >= tau
    if cap is not None:
        keep = keep & (F.col("rank") <= cap)
    return edges_out(r.where(keep | (F.col("rank") == 1)))


def thresholds(pairs: DataFrame, scores: dict[str, str], tau: float = 0.5) -> DataFrame:
    """:func:`threshold` by several score columns at once: (conversation, child, parent, names).

    ``scores``: the column of each name; ``names``: those whose decoding keeps the edge.  The best
    candidate of each score is a maximum per message, so pairs are grouped once and never ranked.
    """
    rows = F.array_compact(F.array(*[F.when(F.col(c) >= tau, F.lit(name)) for name, c in scores.items()]))
    best = [F.max_by("c", F.struct(F.col(c), -F.col("c"))).alias(f"_best{k}") for k, c in enumerate(scores.values())]
    high = F.collect_list(F.when(F.size(rows) > 0, F.struct("c", rows.alias("names")))).alias("_high")
    tops = [F.struct(F.col(f"_best{k}").alias("c"), F.array(F.lit(name)).alias("names")) for k, name in enumerate(scores)]
    kept = pairs.groupBy(*PAIR).agg(high, *best).select(*PAIR, F.inline(F.concat("_high", F.array(*tops))))
    # the best one is among those above tau, if there are any
    merged = kept.groupBy(*PAIR, "c").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    return edges_out(merged, "names")


def tau_grid(pairs: DataFrame, gold: DataFrame, taus: Sequence[float], cap: int = 3, w: int = WINDOW) -> DataFrame:
    """P/R/F1 of the capped threshold decoding for every tau of the grid, in one pass.

    ``pairs`` has all candidates of its messages inside the window ``w``, so the gold edges that
    could be found are counted without looking at it again.
    """
    from threadloom.operators.edge_metrics import in_window, prf
    from threadloom.operators.pairs import label

    top = ranked(pairs).where(F.col("rank") <= cap)
    marked = label(top, gold)
    grid = marked.withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus])))
    kept = grid.where((F.col("score") >= F.col("tau")) | (F.col("rank") == 1))
    n_gold = in_window(gold, w).agg(F.count("*").alias("n_gold")).withColumn("_one", F.lit(1))
    s = kept.groupBy("tau").agg(F.sum("label").alias("tp"), F.count("*").alias("n_pred")).withColumn("_one", F.lit(1)).join(n_gold, "_one")
    s = s.select("tau", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
    return s.select("tau", "tp", "fp", "fn", *prf("tp", "fp", "fn"))


def best_tau(grid: DataFrame) -> DataFrame:
    """The grid row with the highest F1, lowest tau on ties."""
    return grid.agg(F.max_by(F.struct("tau", "F1"), F.struct("F1", -F.col("tau"))).alias("b")).select("b.tau", "b.F1")


def cosine_decay(shared: DataFrame, msgs: DataFrame) -> DataFrame:
    """Highest cosine after decay with distance, nearest on ties; a self link below the minimum."""
    decayed = shared.withColumn("score", F.col("cosine") / (1 + DECAY * (F.col("i") - F.col("c"))))
    top = best(decayed, ties="nearest").where(F.col("score") >= MIN_COSINE)
    found = top.select(*CONV, F.col("i").alias("pos"), F.col("c").alias("hit"))
    out = msgs.select(*CONV, "pos").join(found, [*CONV, "pos"], "left")
    return out.select(*CONV, F.col("pos").alias("child"), F.coalesce("hit", "pos").alias("parent"))


def one_or_two(scores: DataFrame, msgs: DataFrame) -> DataFrame:
    """The best candidate and a close second one; a self link if the best stays below the bias."""
    r = ranked(scores, ties="nearest").where(F.col("rank") <= 2)
    r = r.withColumn("top", F.max("score").over(Window.partitionBy(*PAIR)))
    close = (F.col("score") > F.col("top") - SECOND_MARGIN) & (F.col("score") > SECOND_MIN)
    kept = r.where((F.col("top") >= WEIGHTS["root_bias"]) & ((F.col("rank") == 1) | close))
    found = kept.select(*CONV, F.col("i").alias("pos"), F.col("c").alias("hit"))
    out = msgs.select(*CONV, "pos").join(found, [*CONV, "pos"], "left")
    return out.select(*CONV, F.col("pos").alias("child"), F.coalesce("hit", "pos").alias("parent"))


def softmax_top1(pairs: DataFrame, first: int = 0) -> DataFrame:
    """Softmax over the window (self included = root) and its top candidate, as (.., prob)."""
    w = Window.partitionBy(*PAIR)
    e = pairs.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    p = e.withColumn("prob", F.col("_e") / F.sum("_e").over(w))
    top = best(p.where(F.col("i") >= first), "prob")
    return edges_out(top, "prob")


def easy_first(
    pairs: DataFrame, tau_topic: float = 0.02, tau_complete: float = 0.5, tau_root: float | None = None, max_scan: int = 30
) -> DataFrame:
    """Go through candidates by falling ``prob``; take the first whose ``complete`` passes.

    Root gates: the best probability is below ``tau_root``, or the best candidate is the message
    itself.  The scan ends at ``tau_topic`` or after ``max_scan`` ranks; then the best one is taken.
    """
    r = ranked(pairs, "prob")
    top = F.struct("rank", "c")
    passes = (F.col("c") != F.col("i")) & (F.col("prob") >= tau_topic) & (F.col("complete") >= tau_complete) & (F.col("rank") <= max_scan)
    s = r.groupBy(*PAIR).agg(
        F.max("prob").alias("best"),
        F.min_by("c", "rank").alias("first"),
        F.min(F.when(passes, top)).alias("hit"),
    )
    root = F.col("first") == F.col("i")
    if tau_root is not None:
        root = root | (F.col("best") < tau_root)
    parent = F.when(root, F.col("i")).otherwise(F.coalesce("hit.c", "first"))
    return edges_out(s.select(*CONV, "i", parent.alias("c")))


def oldest_first(pairs: DataFrame, tau_topic: float = 0.05, tau_complete: float = 0.5) -> DataFrame:
    """Scan from the oldest candidate; collect those on topic until one is complete; most probable wins.

    Messages without any candidate on topic are roots and give no row.
    """
    on_topic = pairs.where((F.col("c") != F.col("i")) & (F.col("prob") >= tau_topic))
    stop = F.min(F.when(F.col("complete") >= tau_complete, F.col("c"))).over(Window.partitionBy(*PAIR))
    seen = on_topic.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("c") <= F.col("_stop")))
    return edges_out(best(seen, "prob"))


def fused(pairs: DataFrame, lam: float = 1.0, tau_topic: float = 0.02, k: int = 10) -> DataFrame:
    """Best ``lam * ln(prob) + context`` among the top k on topic; earliest rank on ties."""
    r = ranked(pairs, "prob").where((F.col("rank") <= k) & (F.col("c") != F.col("i")) & ((F.col("prob") >= tau_topic) | (F.col("rank") == 1)))
    r = r.withColumn("fused", lam * F.log(F.greatest("prob", F.lit(1e-9))) + F.col("context"))
    usable = F.when(F.col("prob") >= tau_topic, F.struct(F.col("fused"), -F.col("rank")))
    s = r.groupBy(*PAIR).agg(F.max_by("c", usable).alias("hit"), F.min_by("c", "rank").alias("first"))
    return edges_out(s.select(*CONV, "i", F.coalesce("hit", "first").alias("c")))


def challengers(pairs: DataFrame, features: Sequence[str], tau_topic: float = 0.02, k: int = 10) -> DataFrame:
    """Top-1 candidate against each of ranks 2..k on topic, with both feature sets and their difference."""
    r = ranked(pairs, "prob").where(F.col("rank") <= k)
    # the first row of each message's ranks, taken in place: no pair travels
    first = F.first(F.struct(F.col("c").alias("t"), *[F.col(f).alias(f"t_{f}") for f in features])).over(per_child("rank"))
    both = r.withColumn("_top", first).where((F.col("rank") > 1) & (F.col("prob") >= tau_topic) & (F.col("c") != F.col("i")))
    both = both.select("*", "_top.*").drop("_top").where(F.col("t") != F.col("i"))
    return both.withColumns({f"d_{f}": F.col(f) - F.col(f"t_{f}") for f in features})


def rerank(duels: DataFrame, tops: DataFrame, swap: str, tau: float) -> DataFrame:
    """Replace the top candidate by the challenger with the highest ``swap`` above ``tau``."""
    won = duels.where(F.col(swap) > tau).groupBy(*PAIR).agg(F.max_by("c", F.struct(F.col(swap), -F.col("rank"))).alias("won"))
    out = tops.join(won, PAIR, "left")
    return edges_out(out.select(*CONV, "i", F.coalesce("won", "c").alias("c")))


def sample_negatives(labelled: DataFrame, k: int = 2, seed: int = 7) -> DataFrame:
    """All positives and ``k`` negatives per message, drawn by a seeded hash (stable on reruns)."""
    draw = F.md5(F.concat_ws("|", *CONV, F.col("i").cast("string"), F.col("c").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(*PAIR, "label").orderBy(draw, "c")
    return labelled.withColumn("_n", F.row_number().over(w)).where((F.col("label") == 1) | (F.col("_n") <= k)).drop("_n")


# ---------------------------------------------------------------- votes over prediction tables


def vote(*preds: DataFrame) -> DataFrame:
    """Majority per message over prediction tables with every message present (-1 = root).

    Ties go to the value that was voted for first, in the order of the arguments.
    """
    rows = None
    for n, p in enumerate(preds):
        one = p.select(*CONV, "child", "parent", F.lit(n).alias("nth"))
        rows = one if rows is None else rows.unionByName(one)
    # dealt by message once, for both counts
    counts = rows.repartition(*CONV, "child").groupBy(*CONV, "child", "parent").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    return counts.groupBy(*CONV, "child").agg(F.max_by("parent", F.struct(F.col("n"), -F.col("first"))).alias("parent"))


def filled(msgs: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per message after the first: the predicted parent, or -1 for a root."""
    p = preds.select(*CONV, F.col("child").alias("pos"), F.when(F.col("child") != F.col("parent"), F.col("parent")).alias("parent"))
    out = msgs.where("pos > 0").select(*CONV, "pos").join(p, [*CONV, "pos"], "left")
    return out.select(*CONV, F.col("pos").alias("child"), F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"))


def second_opinion(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """The first vote where two agree, otherwise the majority of three."""
    return vote(first, second, third)

"""Edge-level evaluation of predictions against gold edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import components
from threadloom.schema import CONV, WINDOW
from threadloom.session import materialize

ALG = ["algorithm", *CONV]


def per_algorithm(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Repeat rows once per algorithm name (a fixed short list, no join)."""
    return df.withColumn("algorithm", F.explode(F.array(*[F.lit(n) for n in names])))


def in_window(edges: DataFrame, w: int = WINDOW) -> DataFrame:
    return edges.where((F.col("child") - F.col("parent") <= w) & (F.col("parent") < F.col("child")))


def compare(gold: DataFrame, preds: DataFrame, names: Sequence[str], w: int | None = WINDOW) -> DataFrame:
    """Every edge that is in gold or predicted, once per algorithm, with in_gold / in_pred.

    One aggregation over the union instead of a full outer join: both sides are combined before
    the exchange and a repeated edge counts once.
    """
    g = in_window(gold, w) if w is not None else gold
    both = per_algorithm(g.select(*CONV, "child", "parent"), names).select(
        *ALG, "child", "parent", F.lit(True).alias("g"), F.lit(False).alias("p")
    ).unionByName(preds.select(*ALG, "child", "parent", F.lit(False).alias("g"), F.lit(True).alias("p")))
    return both.groupBy(*ALG, "child", "parent").agg(F.max("g").alias("in_gold"), F.max("p").alias("in_pred"))


def prf(tp: str | Column, fp: str | Column, fn: str | Column, prefix: str = "") -> list[Column]:
    """P, R, F1 in percent with denominators of at least one, rounded to 6 digits."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    p = tp / F.greatest(tp + fp, F.lit(1))
    r = tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    return [F.round(100 * v, 6).alias(prefix + n) for v, n in ((p, "P"), (r, "R"), (f1, "F1"))]


def hits() -> list[Column]:
    g, p = F.col("in_gold"), F.col("in_pred")
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")]


def link_counts(compared: DataFrame, by: Sequence[str] = ("algorithm",)) -> DataFrame:
    return compared.groupBy(*by).agg(*hits())


def link_prf(compared: DataFrame, by: Sequence[str] = ("algorithm",)) -> DataFrame:
    return link_counts(compared, by).select(*by, "tp", "fp", "fn", *prf("tp", "fp", "fn"))


def per_message(compared: DataFrame) -> DataFrame:
    """(algorithm, conversation, child) with the sizes of G, P and their overlap."""
    return compared.groupBy(*ALG, "child").agg(
        F.count_if("in_gold").alias("n_gold"),
        F.count_if("in_pred").alias("n_pred"),
        F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_both"),
    )


def root_prf(msgs: DataFrame, compared: DataFrame) -> DataFrame:
    """Root detection: a message without gold edge in the window counts as a root."""
    n = msgs.agg(F.count("*").alias("n"), F.lit(1).alias("_one"))
    flags = per_message(compared).groupBy("algorithm").agg(
        F.count("*").alias("n_any"),
        F.count_if((F.col("n_gold") == 0) & (F.col("n_pred") > 0)).alias("root_fp"),
        F.count_if((F.col("n_gold") > 0) & (F.col("n_pred") == 0)).alias("root_fn"),
    )
    out = flags.withColumn("_one", F.lit(1)).join(n, "_one").withColumn("root_tp", F.col("n") - F.col("n_any"))
    return out.select("algorithm", "root_tp", "root_fp", "root_fn", *prf("root_tp", "root_fp", "root_fn", "root_"))


def _several(flag_children: Column, flag_parents: Column) -> Column:
    return (
        F.when(flag_parents & flag_children, "many-many")
        .when(flag_parents, "many-1")
        .when(flag_children, "1-many")
        .otherwise("1-1")
    )


def category_prf(gold: DataFrame, preds: DataFrame, compared: DataFrame) -> DataFrame:
    """P/R/F1 by edge class.

    Hits and misses are classed by the gold graph (children counted over all gold edges, parents
    over the window), false positives by the predicted graph.
    """
    # parents with several children: small marker tables, hot parents only mark themselves once
    busy_gold = gold.groupBy(*CONV, "parent").agg(F.count("*").alias("n")).where("n > 1").select(*CONV, "parent", F.lit(True).alias("busy_g"))
    busy_pred = preds.groupBy(*ALG, "parent").agg(F.count("*").alias("n")).where("n > 1").select(*ALG, "parent", F.lit(True).alias("busy_p"))
    sizes = per_message(compared).select(*ALG, "child", "n_gold", "n_pred")
    e = (
        compared.join(sizes, [*ALG, "child"])
        .join(busy_gold, [*CONV, "parent"], "left")
        .join(busy_pred, [*ALG, "parent"], "left")
        .na.fill(False, ["busy_g", "busy_p"])
    )
    category = F.when(F.col("in_gold"), _several(F.col("busy_g"), F.col("n_gold") > 1)).otherwise(
        _several(F.col("busy_p"), F.col("n_pred") > 1)
    )
    counts = e.withColumn("category", category).groupBy("algorithm", "category").agg(*hits())
    return counts.select("algorithm", "category", "tp", "fp", "fn", *prf("tp", "fp", "fn"))


def rates(msgs: DataFrame, gold: DataFrame, compared: DataFrame) -> DataFrame:
    """Missed and invented shares, densities, coverage, recall on several-parent messages."""
    n = msgs.agg(F.count("*").alias("n_scored"), F.lit(1).alias("_one"))
    several = gold.groupBy(*CONV, "child").agg(F.count("*").alias("n")).where("n > 1").select(*CONV, "child", F.lit(True).alias("multi"))
    per = per_message(compared).join(several, [*CONV, "child"], "left").na.fill(False, ["multi"])
    zero = F.lit(0).cast("long")
    agg = per.groupBy("algorithm").agg(
        F.sum("n_both").alias("tp"),
        F.sum(F.col("n_pred") - F.col("n_both")).alias("fp"),
        F.sum(F.col("n_gold") - F.col("n_both")).alias("fn"),
        F.count_if(F.col("n_pred") > 0).alias("n_predicted"),
        F.sum(F.when(F.col("multi"), F.col("n_gold")).otherwise(zero)).alias("mp_gold"),
        F.sum(F.when(F.col("multi"), F.col("n_both")).otherwise(zero)).alias("mp_tp"),
    )
    out = agg.withColumn("_one", F.lit(1)).join(n, "_one")
    one = F.lit(1)
    return out.select(
        "algorithm",
        F.round(100 * F.col("fn") / F.greatest(F.col("tp") + F.col("fn"), one), 6).alias("unidentified_pct"),
        F.round(100 * F.col("fp") / F.greatest(F.col("tp") + F.col("fp"), one), 6).alias("hallucination_pct"),
        F.when(F.col("mp_gold") > 0, F.round(100 * F.try_divide("mp_tp", "mp_gold"), 6)).alias("multi_parent_recall"),
        F.round((F.col("tp") + F.col("fn")) / F.greatest("n_scored", one), 6).alias("density_gold"),
        F.round((F.col("tp") + F.col("fp")) / F.greatest("n_scored", one), 6).alias("density_pred"),
        F.round(100 * F.col("n_predicted") / F.greatest("n_scored", one), 6).alias("coverage_pct"),
        "n_scored",
    )


def labels(
    msgs: DataFrame, gold: DataFrame, preds: DataFrame, names: Sequence[str], w: int | None = WINDOW, limit: int | None = None
) -> DataFrame:
    """(algorithm, conversation, pos, gc, pc): gold and predicted component of every message."""
    g = components(msgs, in_window(gold, w) if w is not None else gold, limit=limit).withColumnRenamed("comp", "gc")
    p = components(per_algorithm(msgs.select(*CONV, "pos"), names), preds, ALG, limit).withColumnRenamed("comp", "pc")
    return materialize(p.join(g, [*CONV, "pos"]).select(*ALG, "pos", "gc", "pc"), "labels")


def overlaps(labelled: DataFrame) -> DataFrame:
    """Shared messages of every touching pair of gold and predicted component, with both sizes."""
    both = labelled.groupBy(*ALG, "gc", "pc").agg(F.count("*").alias("shared"))
    g = labelled.groupBy(*ALG, "gc").agg(F.count("*").alias("n_g"))
    p = labelled.groupBy(*ALG, "pc").agg(F.count("*").alias("n_p"))
    return both.join(g, [*ALG, "gc"]).join(p, [*ALG, "pc"])


def fragmentation(overlap: DataFrame) -> DataFrame:
    """How many predicted components a gold component of two or more is cut into, and its best share."""
    per = (
        overlap.where("n_g >= 2")
        .groupBy(*ALG, "gc")
        .agg(F.count("*").alias("pieces"), (F.max("shared") / F.first("n_g")).alias("best"))
    )
    return per.groupBy("algorithm").agg(
        F.round(F.avg("pieces"), 6).alias("fragmentation"),
        F.round(F.avg("best"), 6).alias("affinity"),
        F.count("*").alias("n_gold_threads"),
    )


def evaluate(msgs: DataFrame, gold: DataFrame, preds: DataFrame, names: Sequence[str], w: int = WINDOW) -> DataFrame:
    """All edge metrics side by side, one row per algorithm."""
    c = materialize(compare(gold, preds, names, w), "compare")
    return (
        link_prf(c)
        .join(root_prf(msgs, c), "algorithm")
        .join(rates(msgs, gold, c), "algorithm")
        .join(fragmentation(overlaps(labels(msgs, gold, preds, names, w))), "algorithm", "left")
    )


def evaluate_from(gold: DataFrame, preds: DataFrame, names: Sequence[str], first: int = 0) -> DataFrame:
    """P/R/F1 over all links, self links included, for messages from position ``first`` on.

    Undefined ratios are 0; no window applies.
    """
    c = compare(gold.where(F.col("child") >= first), preds.where(F.col("child") >= first), names, None)
    s = c.groupBy("algorithm").agg(hits()[0], F.count_if("in_gold").alias("n_gold"), F.count_if("in_pred").alias("n_pred"))
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("n_pred")), zero)
    r = F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("n_gold")), zero)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), zero)
    return s.select(
        "algorithm", "n_gold", "n_pred", F.col("tp").alias("matched"),
        F.round(p, 6).alias("P"), F.round(r, 6).alias("R"), F.round(f1, 6).alias("F1"),
    )


def on_labelled_only(gold: DataFrame, preds: DataFrame, names: Sequence[str]) -> DataFrame:
    """P/R/F1 over messages that have gold parents and are not the first of their conversation."""
    asked = gold.where("child > 0")
    kids = asked.select(*CONV, "child").distinct()
    c = compare(asked, preds.join(kids, [*CONV, "child"], "left_semi"), names, None)
    return link_prf(c)

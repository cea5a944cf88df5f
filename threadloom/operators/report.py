"""Result tables: long metric rows, seeds, audits, pivots, routing, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordered import number_rows, quantiles
from threadloom.schema import CONV


def to_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per metric: (ids, key, value)."""
    cols = [c for c in wide.columns if c not in ids]
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, "key", "value").where("value is not null")


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds and the sorted list of values, per key."""
    runs = F.array_join(F.transform(F.array_sort(F.collect_list(F.round("value", 6))), lambda v: v.cast("string")), ",")
    return metrics.groupBy("dataset", "algorithm", "key").agg(
        F.count("*").alias("n_runs"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), runs.alias("by_run")
    )


def audit(actual: DataFrame, expected: DataFrame, on: Sequence[str], tol: float = 0.15) -> DataFrame:
    """Expected against actual values; a missing value fails."""
    both = expected.join(actual, list(on), "left")
    diff = F.abs(F.col("value") - F.col("expected"))
    return both.select(*on, "expected", "value", diff.alias("diff"), F.coalesce(diff <= tol, F.lit(False)).alias("ok"))


def wide(rows: DataFrame, row: str, col: str, value: str, names: Sequence[str]) -> DataFrame:
    return rows.groupBy(row).pivot(col, list(names)).agg(F.first(value))


def compare_runs(new: DataFrame, old: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Gain of a run over an earlier one; NULL where the earlier one has no value."""
    base = old.select(*keys, F.col(metric).alias("before"))
    return new.select(*keys, F.col(metric).alias("after")).join(base, list(keys), "left").withColumn("gain", F.col("after") - F.col("before"))


def complete_means(rows: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Means over the rows in which every metric is defined."""
    return rows.dropna(subset=list(cols)).groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def best_probe(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per conversation the probe with the highest tp - fp, first of ``order`` on ties.

    ``label`` is the same except that a conversation without any hit is labelled with the first.
    """
    nth = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("algorithm"))
    pick = F.max_by("algorithm", F.struct(F.col("tp") - F.col("fp"), -nth))
    got = counts.groupBy(*CONV).agg(pick.alias("best"), F.max("tp").alias("_tp"))
    return got.select(*CONV, "best", F.when(F.col("_tp") == 0, F.lit(order[0])).otherwise(F.col("best")).alias("label"))


def routed(counts: DataFrame, route: DataFrame, col: str) -> DataFrame:
    """Summed counts of the probe chosen for every conversation."""
    chosen = counts.join(route.select(*CONV, F.col(col).alias("algorithm")), [*CONV, "algorithm"])
    return chosen.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def confusion(rows: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth")).pivot(pred, list(classes)).count().na.fill(0)


def accuracy(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth")).agg(
        F.count("*").alias("n"), F.round(100 * F.avg((F.col(truth) == F.col(pred)).cast("int")), 6).alias("accuracy_pct")
    )


def auc(rows: DataFrame, label: str, score: str, order: Sequence[str]) -> DataFrame:
    """Rank-based area under the curve; equal scores keep the order of ``order`` (no tie correction)."""
    r = number_rows(rows.withColumn("_all", F.lit(0)).withColumn("_s", F.col(score)), ["_all"], ["_s", *order], "_r")
    pos = F.col(label) == 1
    s = r.agg(
        F.sum(F.when(pos, F.col("_r") + 1)).alias("ranks"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg")
    )
    area = F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return s.select("n_pos", "n_neg", F.round(area, 6).alias("auc"))


def score_quantiles(rows: DataFrame, label: str, score: str) -> DataFrame:
    got = quantiles(rows, [label], {f"q{p}": (F.col(score), p / 100) for p in (10, 50, 90)})
    return got.select(label, *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])


def transfer_decay(results: DataFrame) -> DataFrame:
    """F1 lost when a model is applied to another dataset than its own: absolute and relative."""
    own = results.where("source = target").select("target", F.col("F1").alias("own_F1"))
    cross = results.where("source <> target").join(own, "target")
    drop = F.col("own_F1") - F.col("F1")
    return cross.select("source", "target", "F1", "own_F1", drop.alias("drop"), F.try_divide(100 * drop, "own_F1").alias("drop_pct"))

"""Mixing datasets of messages to target weights that change during training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordered import running_sum
from threadloom.session import materialize

#: A dataset is taken at most so many times.
MAX_REPEATS = 3

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text as BIGINT; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sized(messages: DataFrame, seed: int) -> DataFrame:
    """(msg_id, dataset, size, _key): words of each message and its random order, written once."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("msg_id").cast("string")))
    return materialize(messages.select("msg_id", "dataset", word_count("text").alias("size"), key.alias("_key")), "sizes")


def datasets(sizes: DataFrame) -> DataFrame:
    """(dataset, dataset_size): the words of each dataset."""
    return sizes.groupBy("dataset").agg(F.sum("size").alias("dataset_size"))


def targets(totals: DataFrame, schedules: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Words to take of each dataset: (dataset, dataset_size, target, weights, segments).

    A dataset's share follows the integral of its schedule.  Targets stop at ``max_repeats`` times
    the dataset's size and the excess is shared again by weight.  With the datasets in the order of
    cap / weight, the level that fills all caps before a dataset and shares the rest from it on is
    largest at the first dataset that its cap does not stop, so that level gives every target.
    The windows see one row for each dataset.
    """
    w = F.coalesce("weights", F.array(F.lit(1.0), F.lit(1.0)))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("weights") - 2),
        lambda k: F.struct(k.alias("k"), F.get("weights", k).alias("w0"), F.get("weights", k + 1).alias("w1")),
    )
    area = lambda s: (s["w0"] + s["w1"]) / 2
    sched = schedules.select(F.col("dataset").alias("_d"), "weights")
    d = totals.join(sched, F.col("dataset").eqNullSafe(F.col("_d")), "left").drop("_d").withColumn("weights", w)
    d = d.withColumn("segments", pieces)
    d = d.withColumn(
        "segments",
        F.transform("segments", lambda s: F.struct(s["k"].alias("k"), s["w0"].alias("w0"), s["w1"].alias("w1"),
            F.aggregate(F.filter("segments", lambda p: p["k"] < s["k"]), F.lit(0.0), lambda acc, p: acc + area(p)).alias("before"))),
    )
    steps = F.size("segments").cast("double")
    d = d.withColumn("_weight", F.aggregate("segments", F.lit(0.0), lambda acc, p: acc + area(p)) / steps)
    d = d.withColumn("_cap", (max_repeats * F.col("dataset_size")).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.nullif("_weight", F.lit(0.0))).asc_nulls_last(), F.col("dataset").asc_nulls_last())
    filled = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("dataset_size").over(everything).cast("double") - filled) / F.nullif(rest, F.lit(0.0))
    d = d.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    share = F.least("_cap", F.col("_weight") * F.coalesce("_level", F.lit(0.0)))
    return d.select("dataset", "dataset_size", F.coalesce(share, F.lit(0.0)).alias("target"), "weights", "segments")


def when_reached(part: Column, segments: Column) -> Column:
    """Time in [0, 1] at which a schedule has asked for ``part`` of its whole demand."""
    steps = F.size(segments).cast("double")
    last = F.element_at(segments, -1)
    y = part * (last["before"] + (last["w0"] + last["w1"]) / 2)
    seg = F.element_at(F.filter(segments, lambda s: (s["before"] <= y) | (s["k"] == 0)), -1)
    c = y - seg["before"]
    a = (seg["w1"] - seg["w0"]) / 2
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 4 * a * c, F.lit(0.0)))
    x = F.coalesce(2 * c / F.nullif(seg["w0"] + root, F.lit(0.0)), F.lit(0.0))
    return (seg["k"] + F.least(x, F.lit(1.0))) / steps


def curriculum(messages: DataFrame, schedules: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """Training positions of messages under time-varying dataset weights, sorted by position.

    messages(msg_id, dataset, text, ...), schedules(dataset, weights ARRAY<DOUBLE>: the weight at
    equally spaced times from start to end, linear between; positive integral; one row a dataset)
    -> one row a message: msg_id, dataset, size (words), dataset_size, target, taken (words),
    copies ARRAY<STRUCT<position DOUBLE, words BIGINT>>, position (of the first copy).

    The mix has as many words as all messages together.  A dataset is read in a random order that
    depends on ``seed`` and ``msg_id`` alone, from the start again when it is used up; the last
    message taken is cut so that a dataset gives its target (rounded down) exactly.  A copy stands
    where the cumulative demand of its dataset reaches the middle of the copy: the integral of the
    schedule, inverted.  Running sums go over range-partitioned rows, so a dataset may hold any
    share of all messages.

    Null text or no words: size 0, nothing taken, ``position`` null (such rows sort last).  Null
    datasets are one dataset; one without a schedule has weight 1 throughout.  Rows that repeat a
    ``msg_id`` are messages of their own.  Other columns are not kept.  Empty table: empty result.
    """
    rows = sized(messages, seed)
    plan = materialize(targets(datasets(rows), schedules, max_repeats), "targets")
    laid = running_sum(rows, ["dataset"], ["_key", "msg_id", "size"], F.col("size"), "_before", limit=0)
    got = laid.join(plan.withColumnRenamed("dataset", "_d"), F.col("dataset").eqNullSafe(F.col("_d"))).drop("_d")
    most = F.floor("target")

    def copy(e: int) -> Column:
        begin = e * F.col("dataset_size") + F.col("_before")
        words = F.least(F.greatest(most - begin, F.lit(0)), F.col("size"))
        at = when_reached((begin + words / 2) / F.col("target"), F.col("segments"))
        return F.when(words > 0, F.struct(at.alias("position"), words.alias("words")))

    got = got.withColumn("copies", F.filter(F.array(*[copy(e) for e in range(max_repeats)]), lambda c: c.isNotNull()))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    out = got.select("msg_id", "dataset", "size", "dataset_size", "target", taken.alias("taken"), "copies", F.get("copies", F.lit(0))["position"].alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "dataset", "msg_id", "size")

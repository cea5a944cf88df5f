"""Reply-structure profiles of messages and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.graph import depth
from threadloom.operators.ordered import last_before, running_sum
from threadloom.schema import CONV, WINDOW
from threadloom.session import materialize


def with_previous_time(msgs: DataFrame, limit: int | None = None) -> DataFrame:
    """``prev_us``: the last known time stamp before the message in its conversation."""
    return last_before(msgs, CONV, ["pos"], F.col("ts_us"), "prev_us", limit)


def gaps(msgs: DataFrame, limit: int | None = None) -> DataFrame:
    """Positive gaps to the last known time stamp, in seconds."""
    g = with_previous_time(msgs, limit).withColumn("gap", (F.col("ts_us") - F.col("prev_us")) / 1e6)
    return g.where(F.col("gap") > 0).select(*CONV, "pos", "gap")


def lags(msgs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the distance in messages and the delay in seconds."""
    at = msgs.select(*CONV, "pos", "ts_us")
    child = at.withColumnsRenamed({"pos": "child", "ts_us": "t_child"})
    parent = at.withColumnsRenamed({"pos": "parent", "ts_us": "t_parent"})
    e = edges.join(child, [*CONV, "child"]).join(parent, [*CONV, "parent"])
    return e.select(
        *CONV, "child", "parent", (F.col("child") - F.col("parent")).alias("lag"),
        ((F.col("t_child") - F.col("t_parent")) / 1e6).alias("delay"), "t_child",
    )


def quantile_exclusive(values: DataFrame, by: str, value: str, p: float, at_least: int = 10) -> DataFrame:
    """Quantile at p*(n+1) with linear interpolation; NULL for groups below ``at_least`` values.

    Equal values are merged first, so what is ranked is the table of distinct values.
    """
    dist = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    total = dist.groupBy(by).agg(F.sum("_n").alias("total"))
    cum = running_sum(dist, [by], [value], F.col("_n"), "_before").withColumn("upto", F.col("_before") + F.col("_n")).join(total, by)
    h = F.lit(p) * (F.col("total") + 1)
    lo = F.least(F.greatest(F.floor(h), F.lit(1)), F.col("total") - 1)
    ranks = cum.select(by, value, "upto", "total", lo.alias("lo"), h.alias("h"))
    pick = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    got = ranks.groupBy(by).agg(
        pick(F.col("lo")).alias("a"), pick(F.col("lo") + 1).alias("b"), F.first("h").alias("h"), F.first("lo").alias("lo"), F.first("total").alias("total")
    )
    q = F.col("a") + (F.col("h") - F.col("lo")) * (F.col("b") - F.col("a"))
    return got.select(by, F.when(F.col("total") >= at_least, q).alias("q"))


def _pct(n: Column, total: Column) -> Column:
    return F.round(F.try_divide(100.0 * n, total), 6)


def value_cells(df: DataFrame, **metrics: Column) -> DataFrame:
    """(dataset, metric, x, n): how often each value of the metrics occurs; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("x")) for k, v in metrics.items()])
    return df.select("dataset", F.inline(pairs)).where("x is not null").groupBy("dataset", "metric", "x").agg(F.count("*").alias("n"))


def reply_profile(msgs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per dataset: sizes, participants, gaps, roots, lags, delays and depths.

    Every figure comes from one table of (metric, value, count) cells: sums and shares directly,
    quantiles from the running counts of the values, so all metrics are ranked in one pass.
    """
    conv = msgs.groupBy(*CONV).agg(
        F.count("*").alias("size"), F.countDistinct("author").alias("people"), F.count_if(F.contains("text", F.lit("<@"))).alias("mentions")
    )
    kids = edges.groupBy(*CONV, "child").agg(F.count("*").alias("kids"))
    lag = lags(msgs, edges)
    parts = [
        value_cells(conv, size=F.col("size"), people=F.col("people"), mentions=F.col("mentions")),
        value_cells(gaps(msgs), gap=F.col("gap")), value_cells(kids, kids=F.col("kids")),
        value_cells(lag, lag=F.col("lag"), delay=F.col("delay")), value_cells(depth(msgs, edges), depth=F.col("depth")),
    ]
    cells = materialize(reduce(DataFrame.unionByName, parts), "cells")
    ranked = running_sum(cells, ["dataset", "metric"], ["x"], F.col("n"), "before")
    totals = cells.groupBy("dataset", "metric").agg(F.sum("n").alias("total"))
    ranked = ranked.join(totals, ["dataset", "metric"])
    # the rows of a rank: of (n - 1) p for quantiles between the ends, of p (n + 1) beyond them
    inside = lambda p: (F.col("total") - 1) * p
    outside = lambda p: p * (F.col("total") + 1) - 1
    wanted = [("size_median", "size", inside(0.5)), ("people_median", "people", inside(0.5)), ("gap_median", "gap", inside(0.5)), ("lag_median", "lag", inside(0.5)),
              ("delay_median", "delay", inside(0.5)), ("delay_p90", "delay", inside(0.9)), ("size_p90", "size", outside(0.9)), ("gap_p90", "gap", outside(0.9))]
    picks = []
    for name, metric, rank in wanted:
        mine, low = F.col("metric") == metric, F.least(F.greatest(F.floor(rank), F.lit(0)), F.greatest(F.col("total") - 2, F.lit(0)))
        at = lambda k, mine=mine: F.max(F.when(mine & (F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("x")))
        picks += [at(low).alias(f"_a_{name}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"_b_{name}"), F.max(F.when(mine, rank - low)).alias(f"_w_{name}"), F.max(F.when(mine, F.col("total"))).alias(f"_t_{name}")]
    of = lambda metric, value, where=True: F.sum(F.when(F.col("metric") == metric, F.when(F.lit(True) & where, value).otherwise(0)))
    n, weighed = F.col("n"), F.col("n") * F.col("x")
    sums = {
        "n_conv": of("size", n), "n_msg": of("size", weighed), "n_people": of("people", weighed), "n_mentions": of("mentions", weighed),
        "n_parented": of("kids", n), "n_multi": of("kids", n, F.col("x") > 1), "n_edges": of("kids", weighed),
        "n_lag": of("lag", n), "n_near": of("lag", n, F.col("x") <= 5), "n_far": of("lag", n, F.col("x") > 20),
        "n_depth": of("depth", n), "all_depth": of("depth", weighed), "max_depth": F.max(F.when(F.col("metric") == "depth", F.col("x"))),
    }
    got = ranked.groupBy("dataset").agg(*picks, *[v.alias(k) for k, v in sums.items()])
    q = {name: F.col(f"_a_{name}") + F.col(f"_w_{name}") * (F.col(f"_b_{name}") - F.col(f"_a_{name}")) for name, *_ in wanted}
    for name in ("size_p90", "gap_p90"):
        q[name] = F.when(F.col(f"_t_{name}") >= 10, q[name])
    c, whole = F.col, lambda name: F.col(name).cast("long")
    return got.select(
        "dataset", "n_conv", whole("n_msg").alias("n_msg"), q["size_median"].alias("size_median"), F.round(c("n_msg") / c("n_conv"), 6).alias("size_mean"),
        q["people_median"].alias("people_median"), F.round(c("n_people") / c("n_conv"), 6).alias("people_mean"), _pct(c("n_mentions"), c("n_msg")).alias("mention_pct"),
        F.floor(q["gap_median"]).alias("gap_median_sec"), whole("n_edges").alias("n_edges"), q["lag_median"].alias("lag_median"),
        _pct(c("n_near"), c("n_lag")).alias("lag_within5_pct"), _pct(c("n_far"), c("n_lag")).alias("lag_gt20_pct"), (q["lag_median"] - 1).alias("between_median"),
        F.floor(q["delay_median"]).alias("delay_median_sec"), F.round(q["delay_p90"], 6).alias("delay_p90_sec"),
        F.round(c("all_depth") / c("n_depth"), 6).alias("depth_mean"), whole("max_depth").alias("depth_max"), q["size_p90"].alias("size_p90"), F.floor(q["gap_p90"]).alias("gap_p90_sec"),
        _pct(c("n_msg") - c("n_parented"), c("n_msg")).alias("root_pct"), _pct(c("n_multi"), c("n_msg")).alias("multi_parent_pct"), F.round(c("n_edges") / c("n_msg"), 6).alias("mean_parents"),
    )


def hour_histogram(msgs: DataFrame, edges: DataFrame) -> DataFrame:
    """Messages with a parent per dataset and hour of the day (UTC)."""
    kids = edges.select(*CONV, F.col("child").alias("pos")).distinct()
    timed = msgs.where("ts_us is not null").join(kids, [*CONV, "pos"], "left_semi")
    hour = F.pmod(F.floor(F.col("ts_us") / 3_600_000_000), F.lit(24))
    return timed.groupBy("dataset", hour.alias("hour")).agg(F.count("*").alias("n"))


BINS = ["1", "2-3", "4-10", "11-50", "51-100", ">100"]  # fixed values


def distance_bin(d: Column) -> Column:
    return (
        F.when(d <= 1, BINS[0]).when(d <= 3, BINS[1]).when(d <= 10, BINS[2]).when(d <= 50, BINS[3]).when(d <= 100, BINS[4]).otherwise(BINS[5])
    )


def parent_distance(msgs: DataFrame, edges: DataFrame, w: int = WINDOW) -> DataFrame:
    """Per dataset: root/single/multi counts and shares, out-of-window messages, distances."""
    kids = edges.groupBy(*CONV, "child").agg(F.count("*").alias("n"), F.min("parent").alias("far"))
    dist = edges.join(kids, [*CONV, "child"]).withColumn("d", F.col("child") - F.col("parent"))
    single = F.when(F.col("n") == 1, F.col("d"))
    multi = F.when(F.col("n") > 1, F.col("d"))
    q = lambda col, p: F.round(F.percentile(col, F.lit(p)), 6)
    d_part = dist.groupBy("dataset").agg(
        F.round(F.avg(single), 6).alias("single_mean"), q(single, 0.5).alias("single_p50"), q(single, 0.9).alias("single_p90"),
        q(single, 0.99).alias("single_p99"), F.round(F.avg(multi), 6).alias("multi_mean"), q(multi, 0.5).alias("multi_p50"),
    )
    k_part = kids.groupBy("dataset").agg(
        F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_multi"),
        F.count_if(F.col("far") < F.col("child") - w).alias("n_out_of_window"),
    )
    n = msgs.groupBy("dataset").agg(F.count("*").alias("n_msgs"))
    out = n.join(k_part, "dataset").join(d_part, "dataset")
    root = F.col("n_msgs") - F.col("n_single") - F.col("n_multi")
    return out.withColumns(
        {
            "n_root": root,
            "root_pct": _pct(root, F.col("n_msgs")),
            "multi_pct": _pct(F.col("n_multi"), F.col("n_msgs")),
            "multi_pct_of_linked": _pct(F.col("n_multi"), F.col("n_single") + F.col("n_multi")),
        }
    )


def distance_histogram(edges: DataFrame) -> DataFrame:
    kids = edges.groupBy(*CONV, "child").agg(F.count("*").alias("n"), F.max(F.col("child") - F.col("parent")).alias("d"))
    return kids.where("n = 1").groupBy("dataset", distance_bin(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))


def multi_examples(edges: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` messages with several parents per dataset."""
    kids = edges.groupBy(*CONV, "child").agg(F.array_sort(F.collect_set("parent")).alias("p")).where(F.size("p") > 1)
    w = Window.partitionBy("dataset").orderBy("conv_id", "child")
    top = kids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    text = F.array_join(F.transform("p", lambda x: x.cast("string")), ",")
    return top.select(*CONV, "child", text.alias("parents"))


def farthest_histogram(edges: DataFrame, cap: int = 20) -> DataFrame:
    """Distance to the farthest parent, capped."""
    far = edges.groupBy(*CONV, "child").agg(F.max(F.col("child") - F.col("parent")).alias("d"))
    return far.groupBy("dataset", F.least("d", F.lit(cap)).alias("distance")).agg(F.count("*").alias("n"))


def window_coverage(edges: DataFrame, w: int = WINDOW) -> DataFrame:
    inside = (F.col("child") - F.col("parent") <= w).cast("int")
    return edges.groupBy("dataset").agg(F.round(100 * F.avg(inside), 6).alias("coverage_pct"), F.count("*").alias("n_edges"))


VECTOR = ["root_ratio", "multi_ratio", "dist_mean", "dist_median", "delay_mean", "delay_median", "depth_mean", "gap_mean"]


def neighbour_gaps(msgs: DataFrame) -> DataFrame:
    """Seconds between neighbouring messages that both have a time (positions are dense)."""
    at = msgs.where("ts_us is not null").select(*CONV, "pos", "ts_us")
    prev = at.select(*CONV, (F.col("pos") + 1).alias("pos"), F.col("ts_us").alias("before"))
    both = at.join(prev, [*CONV, "pos"])
    return both.select(*CONV, ((F.col("ts_us") - F.col("before")) / 1e6).alias("gap"))


def conversation_vector(msgs: DataFrame, edges: DataFrame) -> DataFrame:
    """Eight structural features per conversation of two or more messages."""
    n = msgs.groupBy(*CONV).agg(F.count("*").alias("n")).where("n >= 2")
    kids = edges.groupBy(*CONV, "child").agg(F.count("*").alias("k")).groupBy(*CONV).agg(
        F.count("*").alias("n_kids"), F.count_if(F.col("k") > 1).alias("n_multi")
    )
    late = F.when(F.col("delay") > 0, F.col("delay"))
    lag = lags(msgs, edges).groupBy(*CONV).agg(
        F.avg("lag").alias("dist_mean"), F.percentile("lag", F.lit(0.5)).alias("dist_median"),
        F.avg(late).alias("delay_mean"), F.percentile(late, F.lit(0.5)).alias("delay_median"),
    )
    deep = depth(msgs, edges, root=1).groupBy(*CONV).agg(F.avg("depth").alias("depth_mean"))
    gap = neighbour_gaps(msgs).groupBy(*CONV).agg(F.avg("gap").alias("gap_mean"))
    out = n
    for part in (kids, lag, deep, gap):
        out = out.join(part, CONV, "left")
    out = out.na.fill(0)
    return out.withColumns(
        {"root_ratio": (F.col("n") - F.col("n_kids")) / F.col("n"), "multi_ratio": F.col("n_multi") / F.col("n")}
    ).select(*CONV, *VECTOR)


ROUTE = ["n", "people", "root_ratio", "mean_dist", "mean_gap", "has_ts_ratio", "n_window_edges"]


def route_features(msgs: DataFrame, edges: DataFrame, w: int = WINDOW) -> DataFrame:
    """Seven features per conversation for choosing a probe.

    Root share, distances and edge counts come from gold edges, so they leak labels at test time.
    """
    m = msgs.groupBy(*CONV).agg(
        F.count("*").alias("n"), F.countDistinct(F.when(F.col("author") != "", F.col("author"))).alias("people"), F.count("ts_us").alias("n_ts")
    )
    kids = edges.groupBy(*CONV).agg(
        F.countDistinct("child").alias("n_kids"), F.avg(F.col("child") - F.col("parent")).alias("mean_dist"),
        F.count_if(F.col("child") - F.col("parent") <= w).alias("n_window_edges"),
    )
    gap = neighbour_gaps(msgs).groupBy(*CONV).agg(F.avg("gap").alias("mean_gap"))
    out = m.join(kids, CONV, "left").join(gap, CONV, "left").na.fill(0)
    return out.withColumns(
        {"root_ratio": (F.col("n") - F.col("n_kids")) / F.col("n"), "has_ts_ratio": F.col("n_ts") / F.col("n")}
    ).select(*CONV, *ROUTE)


def corpus_counts(msgs: DataFrame, edges: DataFrame, split: Column) -> DataFrame:
    """Conversations, messages and edges per dataset and split, with subtotals."""
    m = msgs.groupBy(*CONV).agg(F.count("*").alias("n_msgs"))
    e = edges.groupBy(*CONV).agg(F.count("*").alias("n_edges"))
    per = m.join(e, CONV, "left").na.fill(0).withColumn("split", split)
    return per.rollup("dataset", "split").agg(
        F.count("*").alias("n_conv"), F.sum("n_msgs").alias("n_msgs"), F.sum("n_edges").alias("n_edges")
    )


# ---------------------------------------------------------------- clock-time features


def clock_minutes(text: str | Column) -> Column:
    """Minute of the day of a leading ``[HH:MM]``; NULL without one."""
    c = F.col(text) if isinstance(text, str) else text
    h, m = F.regexp_extract(c, r"^\[(\d{2}):(\d{2})\]", 1), F.regexp_extract(c, r"^\[(\d{2}):(\d{2})\]", 2)
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def minute_diff(a: Column, b: Column) -> Column:
    """Minutes from clock time a to b across midnight; -1 if one is missing.

    Only the hour decides on a wrap, so within one hour the result may be negative.
    """
    ha, hb = F.floor(a / 60), F.floor(b / 60)
    wrapped = F.when(hb < ha, b + 1440 - a).otherwise(b - a)
    return F.coalesce(wrapped, F.lit(-1))


def active_hours(minutes: DataFrame, col: str) -> DataFrame:
    """The 24 hours with their count and whether it reaches the median of all 24."""
    hours = minutes.where(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) / 60).alias("hour")).agg(F.count("*").alias("n"))
    full = hours.sparkSession.range(24).withColumnRenamed("id", "hour").join(hours, "hour", "left").na.fill(0)
    med = full.agg(F.percentile("n", F.lit(0.5)).alias("med")).withColumn("_one", F.lit(1))
    out = full.withColumn("_one", F.lit(1)).join(med, "_one")
    return out.select("hour", "n", (F.col("n") >= F.col("med")).alias("active"))


def time_features(msgs: DataFrame, active: DataFrame, limit: int | None = None) -> DataFrame:
    """log1p of the minutes since the last known clock time (over midnight), and the active flag.

    A message without a time gets 0 and 1.  Needs ``minute``.
    """
    prev = last_before(msgs, CONV, ["pos"], F.col("minute"), "before", limit)
    flagged = prev.withColumn("hour", F.floor(F.col("minute") / 60)).join(active.select("hour", "active"), "hour", "left")
    gap = F.pmod(F.col("minute") - F.col("before"), F.lit(1440))
    known = F.col("minute").isNotNull()
    return flagged.select(
        *CONV, "pos",
        F.when(known & F.col("before").isNotNull(), F.log1p(gap.cast("double"))).otherwise(F.lit(0.0)).alias("log_gap"),
        F.when(known, F.col("active").cast("double")).otherwise(F.lit(1.0)).alias("active"),
    )


def author_neighbours(msgs: DataFrame) -> DataFrame:
    """Previous and next message of the same author and the seconds in between."""
    key = [*CONV, "author"]
    back = last_before(msgs.select(*key, "pos", "ts_us"), key, ["pos"], F.struct(F.col("pos").alias("p"), F.col("ts_us").alias("t")), "prev")
    # the next message is the previous one seen from the other side
    ahead = back.where("prev is not null").select(*CONV, F.col("prev.p").alias("pos"), F.col("pos").alias("next_pos"))
    out = back.join(ahead, [*CONV, "pos"], "left")
    return out.select(*CONV, "pos", F.col("prev.p").alias("prev_pos"), "next_pos", ((F.col("ts_us") - F.col("prev.t")) / 1e6).alias("since_prev"))

"""Queries: reply-structure profiles and time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import profile as pf
from threadloom.operators.normalize import split_of
from threadloom.plans import tables as t
from threadloom.plans.graphs import WALKS
from threadloom.plans.registry import query
from threadloom.plans.shaping import SPLIT
from threadloom.schema import CONV

M = f"WITH {t.MSGS}"
MG = f"WITH RECURSIVE {t.MSGS}, {t.GOLD}"
LAGS = """, lags AS (SELECT g.dataset, g.conv_id, child, parent, child - parent AS lag, (a.ts_us - b.ts_us) / 1e6 AS delay FROM gold g
    JOIN msgs a ON g.conv_id = a.conv_id AND g.child = a.pos JOIN msgs b ON g.conv_id = b.conv_id AND g.parent = b.pos)"""
GAPS = ", gaps AS (SELECT * FROM (SELECT dataset, conv_id, pos, (ts_us - lag(ts_us) OVER (PARTITION BY conv_id ORDER BY pos)) / 1e6 AS gap FROM msgs) WHERE gap > 0)"


def exclusive_sql(rel: str, value: str, p: float, out: str) -> str:
    return f"""{out} AS (SELECT dataset, CASE WHEN count(*) >= 10 THEN max(a) FILTER (k = lo) + (any_value(h) - any_value(lo)) * (max(a) FILTER (k = lo + 1) - max(a) FILTER (k = lo)) END AS q
    FROM (SELECT dataset, {value} AS a, row_number() OVER (PARTITION BY dataset ORDER BY {value}) AS k, {p}::DOUBLE * (count(*) OVER (PARTITION BY dataset) + 1) AS h,
      least(greatest(floor({p}::DOUBLE * (count(*) OVER (PARTITION BY dataset) + 1)), 1), count(*) OVER (PARTITION BY dataset) - 1) AS lo FROM {rel}) GROUP BY 1)"""


@query("w21_positive_gaps", M + GAPS + " SELECT dataset, conv_id, pos, round(gap, 6) AS gap FROM gaps")
def w21(spark, sf):
    return pf.gaps(t.messages(spark, sf)).withColumn("gap", F.round("gap", 6))


@query("j06_edge_lags", MG + LAGS + " SELECT dataset, conv_id, child, parent, lag, round(delay, 6) AS delay FROM lags")
def j06(spark, sf):
    got = pf.lags(t.messages(spark, sf), t.gold(spark, sf))
    return got.select(*CONV, "child", "parent", "lag", F.round("delay", 6).alias("delay"))


@query("m02_quantiles", M + ", c AS (SELECT dataset, conv_id, author, count(*) AS n FROM msgs GROUP BY ALL), " + exclusive_sql("c", "n", 0.9, "x")
       + " SELECT c.dataset, round(any_value(x.q), 6) AS exclusive_p90, round(quantile_cont(n, 0.9), 6) AS inclusive_p90 FROM c JOIN x USING (dataset) GROUP BY 1")
def m02(spark, sf):
    c = t.messages(spark, sf).groupBy(*CONV, "author").agg(F.count("*").alias("n"))
    ex = pf.quantile_exclusive(c, "dataset", "n", 0.9).select("dataset", F.round("q", 6).alias("exclusive_p90"))
    return ex.join(c.groupBy("dataset").agg(F.round(F.percentile("n", F.lit(0.9)), 6).alias("inclusive_p90")), "dataset")


@query(
    "m01_reply_profile",
    MG + LAGS + GAPS + WALKS + """, conv AS (SELECT dataset, conv_id, count(*) AS size, count(DISTINCT author) AS people FROM msgs GROUP BY ALL),
  s AS (SELECT dataset, count(*) AS n_conv, sum(size)::BIGINT AS n_msg, quantile_cont(size, 0.5) AS size_median, round(avg(size), 6) AS size_mean,
    quantile_cont(people, 0.5) AS people_median, round(avg(people), 6) AS people_mean, 100.0::DOUBLE AS mention_pct FROM conv GROUP BY 1),
  gp AS (SELECT dataset, floor(quantile_cont(gap, 0.5))::BIGINT AS gap_median_sec FROM gaps GROUP BY 1),
  k AS (SELECT dataset, count(*) AS kids, count(*) FILTER (n > 1) AS multi, sum(n)::BIGINT AS n_edges FROM (SELECT dataset, conv_id, child, count(*) AS n FROM gold GROUP BY ALL) GROUP BY 1),
  l AS (SELECT dataset, quantile_cont(lag, 0.5) AS lag_median, round(100.0::DOUBLE * count(*) FILTER (lag <= 5) / count(*), 6) AS lag_within5_pct,
    round(100.0::DOUBLE * count(*) FILTER (lag > 20) / count(*), 6) AS lag_gt20_pct, quantile_cont(lag - 1, 0.5) AS between_median,
    floor(quantile_cont(delay, 0.5))::BIGINT AS delay_median_sec, round(quantile_cont(delay, 0.9), 6) AS delay_p90_sec FROM lags GROUP BY 1),
  dp AS (SELECT dataset, round(avg(d), 6) AS depth_mean, max(d)::BIGINT AS depth_max FROM (SELECT dataset, conv_id, node, max(hops) AS d FROM walk GROUP BY ALL) GROUP BY 1), """
    + exclusive_sql("conv", "size", 0.9, "xs") + ", " + exclusive_sql("gaps", "gap", 0.9, "xg")
    + """ SELECT s.*, gap_median_sec, n_edges, lag_median, lag_within5_pct, lag_gt20_pct, between_median, delay_median_sec, delay_p90_sec, depth_mean, depth_max,
    xs.q AS size_p90, floor(xg.q)::BIGINT AS gap_p90_sec, round(100.0::DOUBLE * (n_msg - kids) / n_msg, 6) AS root_pct, round(100.0::DOUBLE * multi / n_msg, 6) AS multi_parent_pct,
    round(n_edges::DOUBLE / n_msg, 6) AS mean_parents FROM s JOIN gp USING (dataset) JOIN k USING (dataset) JOIN l USING (dataset) JOIN dp USING (dataset) JOIN xs USING (dataset) JOIN xg USING (dataset)""",
)
def m01(spark, sf):
    return pf.reply_profile(t.messages(spark, sf), t.gold(spark, sf))


@query(
    "m03_hour_histogram",
    MG + " SELECT dataset, (ts_us // 3600000000) % 24 AS hour, count(*) AS n FROM msgs WHERE (conv_id, pos) IN (SELECT (conv_id, child) FROM gold) GROUP BY ALL",
)
def m03(spark, sf):
    return pf.hour_histogram(t.messages(spark, sf), t.gold(spark, sf))


KIDS = ", kids AS (SELECT dataset, conv_id, child, count(*) AS n, min(parent) AS far FROM gold GROUP BY ALL)"


@query(
    "m04_parent_distance",
    MG + KIDS + """, d AS (SELECT g.dataset, k.n, g.child - g.parent AS d FROM gold g JOIN kids k USING (conv_id, child)),
  dd AS (SELECT dataset, round(avg(d) FILTER (n = 1), 6) AS single_mean, round(quantile_cont(d, 0.5) FILTER (n = 1), 6) AS single_p50, round(quantile_cont(d, 0.9) FILTER (n = 1), 6) AS single_p90,
    round(quantile_cont(d, 0.99) FILTER (n = 1), 6) AS single_p99, round(avg(d) FILTER (n > 1), 6) AS multi_mean, round(quantile_cont(d, 0.5) FILTER (n > 1), 6) AS multi_p50 FROM d GROUP BY 1),
  kk AS (SELECT dataset, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (far < child - 100) AS n_out_of_window FROM kids GROUP BY 1),
  nn AS (SELECT dataset, count(*) AS n_msgs FROM msgs GROUP BY 1)
  SELECT *, n_msgs - n_single - n_multi AS n_root, round(100.0::DOUBLE * (n_msgs - n_single - n_multi) / n_msgs, 6) AS root_pct, round(100.0::DOUBLE * n_multi / n_msgs, 6) AS multi_pct,
    round(100.0::DOUBLE * n_multi / (n_single + n_multi), 6) AS multi_pct_of_linked FROM nn JOIN kk USING (dataset) JOIN dd USING (dataset)""",
)
def m04(spark, sf):
    return pf.parent_distance(t.messages(spark, sf), t.gold(spark, sf))


@query(
    "m04_distance_bins",
    MG + KIDS + """ SELECT dataset, CASE WHEN child - far <= 1 THEN '1' WHEN child - far <= 3 THEN '2-3' WHEN child - far <= 10 THEN '4-10' WHEN child - far <= 50 THEN '11-50'
    WHEN child - far <= 100 THEN '51-100' ELSE '>100' END AS bin, count(*) AS n FROM kids WHERE n = 1 GROUP BY ALL""",
)
def m04_bins(spark, sf):
    return pf.distance_histogram(t.gold(spark, sf))


@query(
    "m04_multi_examples",
    MG + """ SELECT dataset, conv_id, child, string_agg(parent::VARCHAR, ',' ORDER BY parent) AS parents FROM gold GROUP BY dataset, conv_id, child HAVING count(*) > 1
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY conv_id, child) <= 8""",
)
def m04_examples(spark, sf):
    return pf.multi_examples(t.gold(spark, sf))


@query("m05_farthest_histogram", MG + KIDS + " SELECT dataset, least(child - far, 20) AS distance, count(*) AS n FROM kids GROUP BY ALL")
def m05(spark, sf):
    return pf.farthest_histogram(t.gold(spark, sf))


@query("m29_window_coverage", MG + " SELECT dataset, round(100.0::DOUBLE * count(*) FILTER (child - parent <= 100) / count(*), 6) AS coverage_pct, count(*) AS n_edges FROM gold GROUP BY 1")
def m29(spark, sf):
    return pf.window_coverage(t.gold(spark, sf))


@query(
    "m30_corpus_counts",
    MG + f""", p AS (SELECT dataset, conv_id, {SPLIT} AS split, count(*) AS n_msgs FROM msgs GROUP BY ALL), e AS (SELECT conv_id, count(*) AS n FROM gold GROUP BY 1)
  SELECT dataset, split, count(*) AS n_conv, sum(n_msgs)::BIGINT AS n_msgs, sum(coalesce(n, 0))::BIGINT AS n_edges FROM p LEFT JOIN e USING (conv_id) GROUP BY ROLLUP (dataset, split)""",
)
def m30(spark, sf):
    return pf.corpus_counts(t.messages(spark, sf), t.gold(spark, sf), split_of("conv_id"))


@query(
    "f15_conversation_vector",
    MG + LAGS + WALKS + """, n AS (SELECT dataset, conv_id, count(*) AS n FROM msgs GROUP BY ALL), k AS (SELECT conv_id, count(*) AS kids, count(*) FILTER (k > 1) AS multi FROM (SELECT conv_id, child, count(*) AS k FROM gold GROUP BY ALL) GROUP BY 1),
  l AS (SELECT conv_id, avg(lag) AS a, quantile_cont(lag, 0.5) AS b, avg(delay) FILTER (delay > 0) AS c, quantile_cont(delay, 0.5) FILTER (delay > 0) AS d FROM lags GROUP BY 1),
  w AS (SELECT conv_id, avg(d + 1) AS e FROM (SELECT conv_id, node, max(hops) AS d FROM walk GROUP BY ALL) GROUP BY 1),
  g AS (SELECT conv_id, avg(gap) AS f FROM (SELECT conv_id, (ts_us - lag(ts_us) OVER (PARTITION BY conv_id ORDER BY pos)) / 1e6 AS gap FROM msgs) GROUP BY 1)
  SELECT dataset, conv_id, round((n - coalesce(kids, 0))::DOUBLE / n, 6) AS root_ratio, round(coalesce(multi, 0)::DOUBLE / n, 6) AS multi_ratio, round(coalesce(a, 0), 6) AS dist_mean, round(coalesce(b, 0), 6) AS dist_median,
    round(coalesce(c, 0), 6) AS delay_mean, round(coalesce(d, 0), 6) AS delay_median, round(coalesce(e, 0), 6) AS depth_mean, round(coalesce(f, 0), 6) AS gap_mean
  FROM n LEFT JOIN k USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN w USING (conv_id) LEFT JOIN g USING (conv_id) WHERE n >= 2""",
)
def f15(spark, sf):
    got = pf.conversation_vector(t.messages(spark, sf), t.gold(spark, sf))
    return got.withColumns({c: F.round(c, 6) for c in pf.VECTOR})


@query(
    "f16_route_features",
    MG + """, m AS (SELECT dataset, conv_id, count(*) AS n, count(DISTINCT author) AS people FROM msgs GROUP BY ALL),
  k AS (SELECT conv_id, count(DISTINCT child) AS kids, avg(child - parent) AS md, count(*) FILTER (child - parent <= 100) AS we FROM gold GROUP BY 1),
  g AS (SELECT conv_id, avg(gap) AS mg FROM (SELECT conv_id, (ts_us - lag(ts_us) OVER (PARTITION BY conv_id ORDER BY pos)) / 1e6 AS gap FROM msgs) GROUP BY 1)
  SELECT dataset, conv_id, n, people, round((n - coalesce(kids, 0))::DOUBLE / n, 6) AS root_ratio, round(coalesce(md, 0), 6) AS mean_dist, round(coalesce(mg, 0), 6) AS mean_gap,
    1.0::DOUBLE AS has_ts_ratio, coalesce(we, 0) AS n_window_edges FROM m LEFT JOIN k USING (conv_id) LEFT JOIN g USING (conv_id)""",
)
def f16(spark, sf):
    got = pf.route_features(t.messages(spark, sf), t.gold(spark, sf))
    return got.withColumns({c: F.round(c, 6) for c in ("root_ratio", "mean_dist", "mean_gap", "has_ts_ratio")})


def minutes(spark, sf):
    # every seventh message has no clock time, as system lines do
    known = F.col("msg_id") % 7 != 0
    return t.messages(spark, sf).withColumn("minute", F.when(known, F.pmod(F.floor(F.col("ts_us") / 60_000_000), F.lit(1440))))


MIN = M + ", mi AS (SELECT *, CASE WHEN msg_id % 7 <> 0 THEN (ts_us // 60000000) % 1440 END AS minute FROM msgs)"
ACTIVE = """, hh AS (SELECT h AS hour, count(minute) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN mi ON minute // 60 = h GROUP BY 1),
  act AS (SELECT hour, n, n >= (SELECT quantile_cont(n, 0.5) FROM hh) AS active FROM hh)"""


@query("f21_active_hours", MIN + ACTIVE + " SELECT * FROM act")
def f21(spark, sf):
    return pf.active_hours(minutes(spark, sf), "minute")


@query(
    "w22_time_features",
    MIN + ACTIVE + """, p AS (SELECT *, last_value(minute IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mi)
  SELECT p.dataset, conv_id, pos, CASE WHEN minute IS NOT NULL AND before IS NOT NULL THEN round(ln(1 + ((minute - before + 1440) % 1440)::DOUBLE), 6) ELSE 0.0 END AS log_gap,
    CASE WHEN minute IS NULL THEN 1.0 ELSE active::INT::DOUBLE END AS active FROM p LEFT JOIN act ON hour = minute // 60""",
)
def w22(spark, sf):
    m = minutes(spark, sf)
    return pf.time_features(m, pf.active_hours(m, "minute")).withColumn("log_gap", F.round("log_gap", 6))


@query(
    "w20_author_neighbours",
    M + """ SELECT dataset, conv_id, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos, round((ts_us - lag(ts_us) OVER w) / 1e6, 6) AS since_prev
  FROM msgs WINDOW w AS (PARTITION BY conv_id, author ORDER BY pos)""",
)
def w20(spark, sf):
    return pf.author_neighbours(t.messages(spark, sf)).withColumn("since_prev", F.round("since_prev", 6))


@query(
    "f14_minute_diff",
    MIN + """ SELECT dataset, conv_id, pos, CASE WHEN minute IS NULL OR b IS NULL THEN -1 WHEN minute // 60 < b // 60 THEN minute + 1440 - b ELSE minute - b END AS diff
  FROM (SELECT *, lag(minute) OVER (PARTITION BY conv_id ORDER BY pos) AS b FROM mi)""",
)
def f14(spark, sf):
    m = minutes(spark, sf)
    before = m.select(*CONV, (F.col("pos") + 1).alias("pos"), F.col("minute").alias("b"))
    got = m.join(before, [*CONV, "pos"], "left")
    return got.select(*CONV, "pos", pf.minute_diff(F.col("b"), F.col("minute")).alias("diff"))

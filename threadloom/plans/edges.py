"""Queries: silver labelling, probes and edge-level evaluation over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import edge_metrics as em
from threadloom.operators import silver
from threadloom.operators.blocks import band_pairs
from threadloom.operators.probes import run_probes
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.sources.events import with_mentions

MSG_SQL = f"WITH {t.MSGS}"
LOOK6 = f"WITH {t.MSGS}, {t.lookup_sql('look', 6, False, 30)}"


@query("j01_mention_asof", LOOK6 + " SELECT DISTINCT dataset, conv_id, child, parent FROM look WHERE parent IS NOT NULL")
def j01(spark, sf):
    return silver.edges_of(t.lookup(spark, sf))


@query(
    "j01_mention_asof_24h",
    f"WITH {t.MSGS}, {t.GOLD} SELECT dataset, conv_id, child, parent FROM gold",
)
def j01_24(spark, sf):
    return t.gold(spark, sf)


@query(
    "j02_mention_positional",
    MSG_SQL
    + """, ask AS (SELECT dataset, conv_id, pos AS child, 0 AS nth, m1 AS name FROM msgs
                   UNION ALL SELECT dataset, conv_id, pos, 1, m2 FROM msgs)
    SELECT a.dataset, a.conv_id, a.child, a.name, a.nth, p.pos AS parent
    FROM ask a ASOF LEFT JOIN msgs p ON a.conv_id = p.conv_id AND a.name = p.author AND a.child > p.pos""",
)
def j02(spark, sf):
    return silver.positional_lookup(t.messages(spark, sf))


@query(
    "p01_positions",
    MSG_SQL + " SELECT dataset, conv_id, msg_id, pos FROM msgs",
)
def p01(spark, sf):
    return t.messages(spark, sf).select(*CONV, "msg_id", "pos")


@query(
    "m06_silver_stats",
    LOOK6
    + """, pm AS (SELECT conv_id, child, count(*) AS n, count(parent) AS k FROM look GROUP BY ALL),
    a AS (SELECT (SELECT count(*) FROM kept_look) AS n_msgs, count(*) AS n_msgs_with_mention,
                 sum(n)::BIGINT AS n_mentions, sum(k)::BIGINT AS n_resolved, count(*) FILTER (k > 1) AS n_multi_parent FROM pm),
    l AS (SELECT quantile_cont(lag_us / 1e6, 0.5) AS a, quantile_cont(lag_us / 1e6, 0.9) AS b,
                 quantile_cont(child - parent, 0.5) AS c, quantile_cont(child - parent, 0.9) AS d
          FROM look WHERE parent IS NOT NULL)
    SELECT n_msgs, n_msgs_with_mention, n_mentions, n_resolved, n_multi_parent,
           round(100.0 * n_msgs_with_mention / greatest(n_msgs, 1), 6)::DOUBLE AS mention_pct,
           round(100.0 * n_resolved / greatest(n_mentions, 1), 6)::DOUBLE AS resolution_pct,
           round(100.0 * n_multi_parent / greatest(n_msgs, 1), 6)::DOUBLE AS multi_parent_pct,
           floor(a)::BIGINT AS lag_median_sec, floor(b)::BIGINT AS lag_p90_sec,
           floor(c)::BIGINT AS idx_lag_median, floor(d)::BIGINT AS idx_lag_p90 FROM a, l""",
)
def m06(spark, sf):
    msgs = with_mentions(silver.sized(t.messages(spark, sf), 30))
    return silver.silver_stats(msgs, silver.mention_lookup(msgs))


VALIDATE = """, sizes AS (SELECT dataset, count(DISTINCT conv_id) AS n_conv, count(*) AS n_msgs FROM msgs GROUP BY 1),
    v AS (SELECT g.dataset, count(*) AS n_edges, count(*) FILTER (p.ts_us > c.ts_us) AS n_violations FROM gold g
          JOIN msgs c ON g.conv_id = c.conv_id AND g.child = c.pos LEFT JOIN msgs p ON g.conv_id = p.conv_id AND g.parent = p.pos GROUP BY 1)"""


@query(
    "p14_validate",
    f"WITH {t.MSGS}, {t.GOLD} {VALIDATE} "
    "SELECT s.dataset, n_conv, n_msgs, coalesce(n_edges, 0) AS n_edges, coalesce(n_violations, 0) AS n_violations, "
    "coalesce(n_edges, 0) > 0 AND coalesce(n_violations, 0) = 0 AS valid FROM sizes s LEFT JOIN v ON s.dataset = v.dataset",
)
def p14(spark, sf):
    return silver.validate(t.messages(spark, sf), t.gold(spark, sf))


@query(
    "p15_gates",
    f"WITH {t.MSGS}, {t.lookup_sql('look', 6, False, 30)}, {t.GOLD} {VALIDATE}"
    + """, r AS (SELECT round(100.0 * count(parent) / greatest(count(*), 1), 6)::DOUBLE AS resolution_pct FROM look),
    q AS (SELECT round(100.0 * count(*) FILTER (k > 1) / greatest((SELECT count(*) FROM kept_look), 1), 6)::DOUBLE AS multi_parent_pct
          FROM (SELECT conv_id, child, count(parent) AS k FROM look GROUP BY ALL)),
    w AS (SELECT sum(n_violations)::BIGINT AS n_violations FROM v)
    SELECT resolution_pct, n_violations, multi_parent_pct, resolution_pct >= 90 AS g1_resolution, n_violations = 0 AS g2_order,
           multi_parent_pct IS NOT NULL AS g3_recorded FROM r, q, w""",
)
def p15(spark, sf):
    msgs = with_mentions(silver.sized(t.messages(spark, sf), 30))
    stats = silver.silver_stats(msgs, silver.mention_lookup(msgs))
    return silver.gates(stats, silver.validate(t.messages(spark, sf), t.gold(spark, sf)))


@query("w01_prev1", MSG_SQL + " SELECT 'prev1' AS algorithm, dataset, conv_id, pos AS child, pos - 1 AS parent FROM msgs WHERE pos > 0")
def w01(spark, sf):
    return run_probes(t.messages(spark, sf), ["prev1"])


@query(
    "w06_b3_mention",
    MSG_SQL
    + """, a AS (SELECT c.dataset, c.conv_id, c.pos AS child, max(p.pos) AS hit FROM msgs c LEFT JOIN msgs p
                ON c.conv_id = p.conv_id AND p.author = c.m1 AND p.pos < c.pos AND p.pos >= c.pos - 100 GROUP BY ALL)
    SELECT 'b3_mention' AS algorithm, dataset, conv_id, child, coalesce(hit, child) AS parent FROM a""",
)
def w06(spark, sf):
    """The first mention of a message stands in front of its text as the addressee."""
    msgs = with_mentions(t.messages(spark, sf))
    return run_probes(msgs.withColumn("text", F.concat(F.get("mentions", F.lit(0)), F.lit(": "), F.col("text"))), ["b3_mention"])


@query("w02_saprev", f"WITH {t.MSGS}, {t.PREDS} SELECT * FROM preds WHERE algorithm = 'saprev'")
def w02(spark, sf):
    return run_probes(t.messages(spark, sf), ["saprev"])


@query("w04_b1_last", MSG_SQL + " SELECT 'b1_last' AS algorithm, dataset, conv_id, pos AS child, greatest(pos - 1, 0) AS parent FROM msgs")
def w04(spark, sf):
    return run_probes(t.messages(spark, sf), ["b1_last"])


@query(
    "w05_b2_speaker",
    MSG_SQL
    + """ SELECT 'b2_speaker' AS algorithm, dataset, conv_id, pos AS child, CASE WHEN pos - lp <= 100 THEN lp ELSE pos END AS parent
    FROM (SELECT *, lag(pos) OVER (PARTITION BY conv_id, lower(trim(author)) ORDER BY pos) AS lp FROM msgs)""",
)
def w05(spark, sf):
    return run_probes(t.messages(spark, sf), ["b2_speaker"])


@query(
    "j03_candidate_pairs",
    MSG_SQL
    + """ SELECT a.dataset, a.conv_id, count(*) AS n_pairs, sum(a.pos - b.pos)::BIGINT AS gap_sum, max(a.pos - b.pos) AS gap_max
    FROM msgs a JOIN msgs b ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 100 GROUP BY 1, 2""",
)
def j03(spark, sf):
    m = t.messages(spark, sf)
    pairs = band_pairs(m.select(*CONV, F.col("pos").alias("i")), m.select(*CONV, F.col("pos").alias("c")))
    gap = F.col("i") - F.col("c")
    return pairs.groupBy(*CONV).agg(F.count("*").alias("n_pairs"), F.sum(gap).alias("gap_sum"), F.max(gap).alias("gap_max"))


@query("j05_edge_sets", t.EVAL + " SELECT * FROM cmp")
def j05(spark, sf):
    return t.compared(spark, sf)


@query("m07_link_prf", t.EVAL + f", s AS (SELECT algorithm, {t.COUNTS} FROM cmp GROUP BY 1) SELECT algorithm, tp, fp, fn, {t.prf_sql()} FROM s")
def m07(spark, sf):
    return em.link_prf(t.compared(spark, sf))


PER_MSG = """, pm AS (SELECT algorithm, dataset, conv_id, child, count(*) FILTER (in_gold) AS n_gold, count(*) FILTER (in_pred) AS n_pred,
    count(*) FILTER (in_gold AND in_pred) AS n_both FROM cmp GROUP BY ALL)"""


@query("k05_message_sets", t.EVAL + PER_MSG + " SELECT * FROM pm")
def k05(spark, sf):
    return em.per_message(t.compared(spark, sf))


@query(
    "m08_root_prf",
    t.EVAL
    + PER_MSG
    + f""", s AS (SELECT algorithm, (SELECT count(*) FROM msgs) - count(*) AS root_tp, count(*) FILTER (n_gold = 0 AND n_pred > 0) AS root_fp,
      count(*) FILTER (n_gold > 0 AND n_pred = 0) AS root_fn FROM pm GROUP BY 1)
    SELECT algorithm, root_tp, root_fp, root_fn, {t.prf_sql('root_tp', 'root_fp', 'root_fn', 'root_')} FROM s""",
)
def m08(spark, sf):
    return em.root_prf(t.messages(spark, sf), t.compared(spark, sf))


@query(
    "m09_category_prf",
    t.EVAL
    + PER_MSG
    + f""", gc AS (SELECT conv_id, parent, count(*) AS n FROM gold GROUP BY ALL),
    pc AS (SELECT algorithm, conv_id, parent, count(*) AS n FROM preds GROUP BY ALL),
    e AS (SELECT c.*, CASE WHEN in_gold THEN n_gold ELSE n_pred END AS np, CASE WHEN in_gold THEN gc.n ELSE pc.n END AS nc
      FROM cmp c JOIN pm USING (algorithm, conv_id, child) LEFT JOIN gc ON c.conv_id = gc.conv_id AND c.parent = gc.parent
      LEFT JOIN pc ON c.algorithm = pc.algorithm AND c.conv_id = pc.conv_id AND c.parent = pc.parent),
    s AS (SELECT algorithm, CASE WHEN np > 1 AND nc > 1 THEN 'many-many' WHEN np > 1 THEN 'many-1' WHEN nc > 1 THEN '1-many' ELSE '1-1' END AS category,
      {t.COUNTS} FROM e GROUP BY ALL)
    SELECT algorithm, category, tp, fp, fn, {t.prf_sql()} FROM s""",
)
def m09(spark, sf):
    return em.category_prf(t.gold(spark, sf), t.preds(spark, sf), t.compared(spark, sf))


@query(
    "m10_rates",
    t.EVAL
    + PER_MSG
    + """, mp AS (SELECT conv_id, child FROM gold GROUP BY ALL HAVING count(*) > 1),
    s AS (SELECT algorithm, sum(n_both) AS tp, sum(n_pred - n_both) AS fp, sum(n_gold - n_both) AS fn, count(*) FILTER (n_pred > 0) AS k,
      sum(CASE WHEN mp.child IS NOT NULL THEN n_gold ELSE 0 END) AS mg, sum(CASE WHEN mp.child IS NOT NULL THEN n_both ELSE 0 END) AS mt,
      (SELECT count(*) FROM msgs) AS n FROM pm LEFT JOIN mp USING (conv_id, child) GROUP BY 1)
    SELECT algorithm, round(100.0 * fn::DOUBLE / greatest(tp + fn, 1), 6) AS unidentified_pct, round(100.0 * fp::DOUBLE / greatest(tp + fp, 1), 6) AS hallucination_pct,
      CASE WHEN mg > 0 THEN round(100.0 * mt::DOUBLE / mg, 6) END AS multi_parent_recall, round((tp + fn)::DOUBLE / greatest(n, 1), 6) AS density_gold,
      round((tp + fp)::DOUBLE / greatest(n, 1), 6) AS density_pred, round(100.0 * k::DOUBLE / greatest(n, 1), 6) AS coverage_pct, n AS n_scored FROM s""",
)
def m10(spark, sf):
    return em.rates(t.messages(spark, sf), t.gold(spark, sf), t.compared(spark, sf))

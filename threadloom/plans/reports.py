"""Queries: result tables built from metrics of the other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import chain_metrics as cm
from threadloom.operators import edge_metrics as em
from threadloom.operators import report
from threadloom.operators.normalize import split_of
from threadloom.operators.probes import run_probes
from threadloom.plans import tables as t
from threadloom.plans.graphs import CHAIN, RATIOS, chain_rows, rounded
from threadloom.plans.registry import query
from threadloom.plans.shaping import SPLIT
from threadloom.schema import CONV
from threadloom.session import tune

# the weeks of a dataset stand in for the seeds of a run
SEEDS = t.EVAL + f""", s AS (SELECT algorithm, dataset, conv_id, {t.COUNTS} FROM cmp GROUP BY ALL), m AS (SELECT algorithm, dataset, conv_id, {t.prf_sql()} FROM s)"""


def seed_rows(spark, sf):
    prf = em.link_prf(t.compared(spark, sf), ["algorithm", *CONV]).drop("tp", "fp", "fn")
    return report.to_long(prf.withColumnRenamed("conv_id", "seed"), ["algorithm", "dataset", "seed"])


@query("a15_long_metrics", SEEDS + " SELECT algorithm, dataset, conv_id AS seed, unnest(['P', 'R', 'F1']) AS key, unnest([P, R, F1]) AS value FROM m")
def a15(spark, sf):
    return seed_rows(spark, sf)


@query(
    "m17_seed_summary",
    SEEDS + """, l AS (SELECT algorithm, dataset, unnest(['P', 'R', 'F1']) AS key, unnest([P, R, F1]) AS value FROM m)
  SELECT dataset, algorithm, key, count(*) AS n_runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l GROUP BY ALL""",
)
def m17(spark, sf):
    return report.seed_summary(seed_rows(spark, sf)).drop("by_run")


@query("m23_wide_table", SEEDS.replace("conv_id, {", "{") + """, d AS (SELECT dataset, algorithm, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY ALL),
  f AS (SELECT dataset, algorithm, """ + t.prf_sql() + """ FROM d) SELECT dataset, max(F1) FILTER (algorithm = 'prev1') AS prev1, max(F1) FILTER (algorithm = 'saprev') AS saprev FROM f GROUP BY 1""")
def m23(spark, sf):
    prf = em.link_prf(t.compared(spark, sf), ["algorithm", "dataset"])
    return report.wide(prf, "dataset", "algorithm", "F1", t.NAMES)


@query("m14_component_rows", CHAIN + """ SELECT algorithm, dataset, conv_id, n_msgs, n_gold_components_multi, n_pred_components_multi, n_exact_multi,
  CASE WHEN n_pred_components_multi > 0 THEN round(n_exact_multi::DOUBLE / n_pred_components_multi, 6) END AS component_exact_rate FROM cnt""")
def m14(spark, sf):
    got = chain_rows(spark, sf)
    cols = ["n_msgs", "n_gold_components_multi", "n_pred_components_multi", "n_exact_multi"]
    return got.select(*em.ALG, *cols, F.round("component_exact_rate", 6).alias("component_exact_rate"))


@query("m15_group_summary", CHAIN + f", r AS (SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt) SELECT dataset, algorithm, count(*) AS n_conv, round(avg(path_f1), 6) AS path_f1, round(avg(component_exact_rate), 6) AS exact_rate, round(avg(ancestor_jaccard), 6) AS jaccard FROM r GROUP BY ALL")
def m15(spark, sf):
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return chain_rows(spark, sf).groupBy("dataset", "algorithm").agg(
        F.count("*").alias("n_conv"), mean("path_f1", "path_f1"), mean("component_exact_rate", "exact_rate"), mean("ancestor_jaccard", "jaccard")
    )


@query("m33_ancestor_table", CHAIN + """, d AS (SELECT dataset, algorithm, round(100 * sum(jaccard_sum) / sum(n_anc_msgs), 6) AS m3 FROM cnt GROUP BY ALL)
  SELECT dataset, max(m3) FILTER (algorithm = 'prev1') AS prev1, max(m3) FILTER (algorithm = 'saprev') AS saprev FROM d GROUP BY 1""")
def m33(spark, sf):
    nodes = t.messages(spark, sf).select(*CONV, "pos")
    rows = cm.ancestor_overlap(nodes, t.gold(spark, sf), t.preds(spark, sf), t.NAMES)
    pooled = rows.groupBy("dataset", "algorithm").agg(F.round(100 * F.avg("jaccard"), 6).alias("m3"))
    return report.wide(pooled, "dataset", "algorithm", "m3", t.NAMES)


@query("m37_zero_filled", CHAIN + f", r AS (SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt) SELECT algorithm, dataset, conv_id, path_f1_zero_filled AS path_F1, component_recall, ancestor_jaccard FROM r")
def m37(spark, sf):
    got = rounded(chain_rows(spark, sf))
    return got.select(*em.ALG, F.col("path_f1_zero_filled").alias("path_F1"), "component_recall", "ancestor_jaccard")


@query("m31_run_summary", CHAIN + f", r AS (SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt) SELECT dataset, algorithm, count(*) AS n_conv, round(avg(path_f1_zero_filled), 6) AS path_f1_zero_filled, count(*) FILTER (path_f1 IS NULL) AS n_degenerate, count(*) FILTER (gold_truncated OR pred_truncated) AS n_truncated, sum(n_msgs)::BIGINT AS n_calls FROM r GROUP BY ALL")
def m31(spark, sf):
    rows = chain_rows(spark, sf).withColumn("note", F.concat(F.lit("model=x calls="), F.col("n_msgs").cast("string")))
    calls = F.regexp_extract("note", r"calls=(\d+)", 1).cast("long")
    return rows.groupBy("dataset", "algorithm").agg(
        F.count("*").alias("n_conv"), F.round(F.avg("path_f1_zero_filled"), 6).alias("path_f1_zero_filled"),
        F.count_if(F.col("path_f1").isNull()).alias("n_degenerate"), F.count_if(F.col("gold_truncated") | F.col("pred_truncated")).alias("n_truncated"),
        F.sum(calls).alias("n_calls"),
    )


@query("j10_complete_means", CHAIN + f", r AS (SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt) SELECT algorithm, count(*) AS n, round(avg(path_f1), 6) AS path_f1, round(avg(component_recall), 6) AS component_recall, round(avg(ancestor_jaccard), 6) AS ancestor_jaccard FROM r WHERE path_f1 IS NOT NULL AND component_recall IS NOT NULL AND ancestor_jaccard IS NOT NULL GROUP BY 1")
def j10(spark, sf):
    return report.complete_means(chain_rows(spark, sf), ["algorithm"], ["path_f1", "component_recall", "ancestor_jaccard"])


@query("j09_run_gain", SEEDS + " SELECT a.dataset, a.conv_id, a.F1 AS after, b.F1 AS before, round(a.F1 - b.F1, 6) AS gain FROM m a LEFT JOIN m b ON a.conv_id = b.conv_id AND b.algorithm = 'prev1' WHERE a.algorithm = 'saprev'")
def j09(spark, sf):
    rows = em.link_prf(t.compared(spark, sf), ["algorithm", *CONV])
    new, old = rows.where("algorithm = 'saprev'"), rows.where("algorithm = 'prev1'")
    return report.compare_runs(new, old, CONV, "F1").withColumn("gain", F.round("gain", 6))


@query("j08_component_exact", CHAIN + " SELECT algorithm, dataset, conv_id, n_exact, n_gold_components, n_pred_components FROM cnt")
def j08(spark, sf):
    from threadloom.operators.graph import valid_edges

    m, g, p = t.messages(spark, sf), valid_edges(t.gold(spark, sf)), t.preds(spark, sf)
    got = cm.component_matches(em.labels(m, g, p, t.NAMES, None))
    return got.select(*em.ALG, "n_exact", "n_gold_components", "n_pred_components")


@query("j07_component_overlap", CHAIN + " SELECT algorithm, n.dataset, conv_id, gc, pc, ov.n AS shared FROM ov JOIN (SELECT DISTINCT dataset, conv_id FROM msgs) n USING (conv_id)")
def j07(spark, sf):
    m, g, p = t.messages(spark, sf), t.gold(spark, sf), t.preds(spark, sf)
    return em.overlaps(em.labels(m, g, p, t.NAMES, None)).select(*em.ALG, "gc", "pc", "shared")


@query("m22_audit", SEEDS + """, d AS (SELECT dataset, algorithm, round(avg(F1), 6) AS value FROM m GROUP BY ALL)
  SELECT dataset, algorithm, round(value + CASE WHEN algorithm = 'prev1' THEN 0.1 ELSE 0.5 END, 6) AS expected, value, round(CASE WHEN algorithm = 'prev1' THEN 0.1 ELSE 0.5 END, 6)::DOUBLE AS diff, algorithm = 'prev1' AS ok FROM d""")
def m22(spark, sf):
    rows = em.link_prf(t.compared(spark, sf), ["algorithm", *CONV])
    actual = rows.groupBy("dataset", "algorithm").agg(F.round(F.avg("F1"), 6).alias("value"))
    off = F.when(F.col("algorithm") == "prev1", 0.1).otherwise(0.5)
    expected = actual.select("dataset", "algorithm", F.round(F.col("value") + off, 6).alias("expected"))
    return report.audit(actual, expected, ["dataset", "algorithm"]).withColumn("diff", F.round("diff", 6))


B_SQL = """, lp AS (SELECT *, lag(pos) OVER (PARTITION BY conv_id, author ORDER BY pos) AS p FROM msgs),
  bp AS (SELECT 'b1_last' AS algorithm, dataset, conv_id, pos AS child, greatest(pos - 1, 0) AS parent FROM msgs UNION ALL SELECT 'b2_speaker', dataset, conv_id, pos, CASE WHEN pos - p <= 100 THEN p ELSE pos END FROM lp),
  gs AS (SELECT dataset, conv_id, child, parent FROM gold UNION ALL SELECT dataset, conv_id, pos, pos FROM msgs WHERE (conv_id, pos) NOT IN (SELECT (conv_id, child) FROM gold))"""


def prf_from(where: str = "true") -> str:
    return f""", x AS (SELECT a.algorithm, (SELECT count(*) FROM gs WHERE {where}) AS n_gold, count(*) AS n_pred, count(g.child) AS matched FROM (SELECT * FROM bp WHERE {where}) a
    LEFT JOIN gs g ON a.conv_id = g.conv_id AND a.child = g.child AND a.parent = g.parent GROUP BY 1)
  SELECT algorithm, n_gold, n_pred, matched, round(100.0::DOUBLE * matched / n_pred, 6) AS P, round(100.0::DOUBLE * matched / n_gold, 6) AS R, round(200.0::DOUBLE * matched / (n_pred + n_gold), 6) AS F1 FROM x"""


def with_roots(spark, sf):
    """Gold edges plus a self link for every message without one."""
    m, g = t.messages(spark, sf), t.gold(spark, sf)
    kids = g.select(*CONV, F.col("child").alias("pos"))
    roots = m.select(*CONV, "pos").join(kids, [*CONV, "pos"], "left_anti")
    return g.unionByName(roots.select(*CONV, F.col("pos").alias("child"), F.col("pos").alias("parent")))


BASE = ["b1_last", "b2_speaker"]


@query("m07_link_prf_from", f"WITH {t.MSGS}, {t.GOLD} {B_SQL} {prf_from('child >= 100')}")
def m07_from(spark, sf):
    return em.evaluate_from(with_roots(spark, sf), run_probes(t.messages(spark, sf), BASE), BASE, first=100)


@query("m38_test_split_prf", f"WITH {t.MSGS}, {t.GOLD} {B_SQL} {prf_from(SPLIT + chr(32) + '=' + chr(32) + chr(39) + 'test' + chr(39))}")
def m38(spark, sf):
    test = split_of("conv_id") == "test"
    return em.evaluate_from(with_roots(spark, sf).where(test), run_probes(t.messages(spark, sf), BASE).where(test), BASE)


@query("m25_prev1_on_labelled", t.EVAL + f""", k AS (SELECT DISTINCT conv_id, child FROM gold WHERE child > 0),
  s AS (SELECT 'prev1' AS algorithm, count(g.child) AS tp, count(*) - count(g.child) AS fp, (SELECT count(*) FROM gold WHERE child > 0) - count(g.child) AS fn
    FROM preds p JOIN k USING (conv_id, child) LEFT JOIN gold g ON g.conv_id = p.conv_id AND g.child = p.child AND g.parent = p.parent WHERE p.algorithm = 'prev1')
  SELECT algorithm, tp, fp, fn, {t.prf_sql()} FROM s""")
def m25(spark, sf):
    return em.on_labelled_only(t.gold(spark, sf), t.preds(spark, sf, ["prev1"]), ["prev1"])


ROUTE = t.EVAL + f""", s AS (SELECT algorithm, dataset, conv_id, {t.COUNTS} FROM cmp GROUP BY ALL),
  b AS (SELECT dataset, conv_id, arg_max(algorithm, (tp - fp, CASE WHEN algorithm = 'prev1' THEN 1 ELSE 0 END)) AS best, max(tp) AS mt FROM s GROUP BY ALL),
  bl AS (SELECT dataset, conv_id, best, CASE WHEN mt = 0 THEN 'prev1' ELSE best END AS label FROM b)"""


def probe_counts(spark, sf):
    return em.link_counts(t.compared(spark, sf), ["algorithm", *CONV])


@query("m28_best_probe", ROUTE + " SELECT * FROM bl")
def m28(spark, sf):
    return report.best_probe(probe_counts(spark, sf), t.NAMES)


@query("m28_oracle_route", ROUTE + f", c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s JOIN bl ON s.conv_id = bl.conv_id AND s.algorithm = bl.best) SELECT tp, fp, fn, {t.prf_sql()} FROM c")
def m28_oracle(spark, sf):
    c = probe_counts(spark, sf)
    return report.routed(c, report.best_probe(c, t.NAMES), "best").select("tp", "fp", "fn", *em.prf("tp", "fp", "fn"))


@query("m34_routing_table", ROUTE + f""", d AS (SELECT s.dataset, s.algorithm, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY ALL),
  f AS (SELECT dataset, algorithm, {t.prf_sql()} FROM d), o AS (SELECT s.dataset, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s JOIN bl ON s.conv_id = bl.conv_id AND s.algorithm = bl.best GROUP BY 1),
  of AS (SELECT dataset, {t.prf_sql()} FROM o) SELECT of.dataset, of.F1 AS oracle_F1, max(f.F1) AS best_single, round(of.F1 - max(f.F1), 6) AS gain FROM of JOIN f USING (dataset) GROUP BY of.dataset, of.F1""")
def m34(spark, sf):
    c = probe_counts(spark, sf)
    best = report.best_probe(c, t.NAMES).select(*CONV, F.col("best").alias("algorithm"))
    sums = [F.sum(x).alias(x) for x in ("tp", "fp", "fn")]
    oracle = c.join(best, [*CONV, "algorithm"]).groupBy("dataset").agg(*sums)
    oracle = oracle.select("dataset", em.prf("tp", "fp", "fn")[2].alias("oracle_F1"))
    single = c.groupBy("dataset", "algorithm").agg(*sums).select("dataset", em.prf("tp", "fp", "fn")[2])
    top = single.groupBy("dataset").agg(F.max("F1").alias("best_single"))
    return oracle.join(top, "dataset").withColumn("gain", F.round(F.col("oracle_F1") - F.col("best_single"), 6))


@query("m24_transfer_decay", SEEDS + """, d AS (SELECT dataset AS target, algorithm AS probe, avg(F1) AS F1 FROM m GROUP BY ALL), r AS (SELECT a.dataset AS source, d.target, d.F1 FROM (SELECT DISTINCT dataset FROM m) a CROSS JOIN d WHERE (d.probe = 'saprev') = (a.dataset <> d.target) )
  SELECT r.source, r.target, round(r.F1, 6) AS F1, round(o.F1, 6) AS own_F1, round(o.F1 - r.F1, 6) AS "drop", round(100 * (o.F1 - r.F1) / o.F1, 6) AS drop_pct FROM r JOIN r o ON o.target = r.target AND o.source = o.target WHERE r.source <> r.target""")
def m24(spark, sf):
    rows = em.link_prf(t.compared(spark, sf), ["algorithm", *CONV]).groupBy("dataset", "algorithm").agg(F.avg("F1").alias("F1"))
    names = [r[0] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # the few dataset names
    each = rows.withColumnRenamed("dataset", "target").withColumn("source", F.explode(F.array(*[F.lit(n) for n in names])))
    results = each.where((F.col("algorithm") == "saprev") == (F.col("source") != F.col("target")))
    got = report.transfer_decay(results)
    return got.withColumns({c: F.round(c, 6) for c in ("F1", "own_F1", "drop", "drop_pct")})


def label_rows(spark, sf):
    tune(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", "lang")
    return spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id")


@query("m26_confusion", """WITH r AS (SELECT quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id))
  SELECT quality AS truth, count(*) FILTER (pred = 0) AS "0", count(*) FILTER (pred = 1) AS "1" FROM r GROUP BY 1""")
def m26(spark, sf):
    rows = label_rows(spark, sf).withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return report.confusion(rows, "quality", "pred", [0, 1])


@query("m26_accuracy", """SELECT quality AS truth, count(*) AS n, round(100 * avg((quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT), 6) AS accuracy_pct FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def m26_accuracy(spark, sf):
    rows = label_rows(spark, sf).withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return report.accuracy(rows, "quality", "pred")


@query("m27_auc", """WITH r AS (SELECT quality, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT sum(r) FILTER (quality = 1) AS ranks, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg FROM r)
  SELECT n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2)::DOUBLE / (n_pos * n_neg), 6) AS auc FROM s""")
def m27(spark, sf):
    return report.auc(label_rows(spark, sf), "quality", "n_chars", ["doc_id"])


@query("m27_score_quantiles", """SELECT quality, round(quantile_cont(n_chars, 0.1), 6) AS q10, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.9), 6) AS q90 FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def m27_quantiles(spark, sf):
    return report.score_quantiles(label_rows(spark, sf), "quality", "n_chars")

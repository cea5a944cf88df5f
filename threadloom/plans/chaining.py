"""Queries: chains, pruning, tracing, themes, votes, metric layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import chains as ch
from threadloom.operators import decode, graph, layers
from threadloom.operators import edge_metrics as em
from threadloom.operators.silver import edges_of
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.plans.scoring import MP, event_pairs
from threadloom.schema import CONV
from threadloom.sources.events import prepared

M = f"WITH RECURSIVE {t.MSGS}"
# single-parent gold: the first mention within 24 hours
ONE = t.lookup_sql("look1", 24, True, 0) + ", one AS MATERIALIZED (SELECT DISTINCT dataset, conv_id, child, parent FROM look1 WHERE parent IS NOT NULL)"
MO = f"{M}, {ONE}"
UPWALK = """, up AS (SELECT dataset, conv_id, pos AS node, pos AS here, 0 AS hops FROM msgs
  UNION ALL SELECT u.dataset, u.conv_id, u.node, g.parent, u.hops + 1 FROM up u JOIN one g ON u.conv_id = g.conv_id AND u.here = g.child),
  gchain AS (SELECT dataset, conv_id, node AS pos, string_agg(here::VARCHAR, '>' ORDER BY hops DESC) AS chain, count(*) AS len FROM up GROUP BY ALL)"""


def single_gold(spark, sf):
    return prepared(spark, ("single", sf), lambda: edges_of(t.lookup(spark, sf, 24, True, 0)))


def text_chain(df, col="chain"):
    return df.withColumn(col, F.array_join(F.transform(col, lambda x: x.cast("string")), ">"))


@query("g07_chains", MO + UPWALK + " SELECT dataset, conv_id, pos, chain FROM gchain")
def g07(spark, sf):
    return text_chain(ch.chains(t.messages(spark, sf).select(*CONV, "pos"), single_gold(spark, sf)))


@query("m32_chain_lengths", MO + UPWALK + " SELECT dataset, min(len)::INTEGER AS min_len, max(len)::INTEGER AS max_len, round(avg(len), 6) AS mean_len FROM gchain GROUP BY 1")
def m32(spark, sf):
    return layers.chain_lengths(t.messages(spark, sf), single_gold(spark, sf))


# every message points at the first message of the user it mentions first, wherever that is
PTR = """, firsts AS (SELECT conv_id, author, min(pos) AS up FROM msgs GROUP BY ALL),
  ptr AS (SELECT m.dataset, m.conv_id, m.pos AS node, f.up FROM msgs m JOIN firsts f ON m.conv_id = f.conv_id AND m.m1 = f.author WHERE m.pos > 0),
  orbit AS (SELECT dataset, conv_id, node, up AS here FROM ptr UNION SELECT o.dataset, o.conv_id, o.node, p.up FROM orbit o JOIN ptr p ON o.conv_id = p.conv_id AND o.here = p.node),
  cyc AS (SELECT dataset, conv_id, node, least(node, min(here)) AS lowest FROM orbit GROUP BY dataset, conv_id, node
    HAVING count(*) FILTER (NOT EXISTS (SELECT 1 FROM ptr p WHERE p.conv_id = orbit.conv_id AND p.node = orbit.here)) = 0)"""


def pointers(spark, sf):
    m = t.messages(spark, sf)
    firsts = m.groupBy(*CONV, F.col("author").alias("asked")).agg(F.min("pos").alias("up"))
    asked = m.where("pos > 0").select(*CONV, F.col("pos").alias("node"), F.get(tx.mentions("text"), F.lit(0)).alias("asked"))
    return asked.join(firsts, [*CONV, "asked"]).select(*CONV, "node", "up")


@query("g08_cycles", M + PTR + " SELECT dataset, conv_id, node, lowest FROM cyc")
def g08(spark, sf):
    return graph.cyclic(pointers(spark, sf))


@query("g08_break_cycles", M + PTR + " SELECT p.dataset, p.conv_id, p.node, p.up FROM ptr p LEFT JOIN cyc c ON p.conv_id = c.conv_id AND p.node = c.node AND c.node = c.lowest WHERE c.node IS NULL")
def g08_break(spark, sf):
    return graph.break_cycles(pointers(spark, sf))


@query(
    "w26_cycle_repair",
    M + PTR + " SELECT p.dataset, p.conv_id, p.node AS child, CASE WHEN c.node IS NULL THEN p.up ELSE p.node - 1 END AS parent FROM ptr p LEFT JOIN cyc c ON p.conv_id = c.conv_id AND p.node = c.node",
)
def w26(spark, sf):
    p = pointers(spark, sf)
    bad = graph.cyclic(p).select(*CONV, "node", F.lit(True).alias("bad"))
    # a cyclic node takes its second prediction, the previous message
    got = p.join(bad, [*CONV, "node"], "left")
    return got.select(*CONV, F.col("node").alias("child"), F.when(F.col("bad"), F.col("node") - 1).otherwise(F.col("up")).alias("parent"))


PRUNE = (
    MP.replace("WITH ", "WITH RECURSIVE ", 1).replace("pairs AS (", "pairs AS MATERIALIZED (", 1).replace("  sc AS (", "  sc AS MATERIALIZED (", 1)
    + """, b AS MATERIALIZED (SELECT dataset, conv_id, i, max(score) AS top, arg_min(c, (-score, c)) AS arg FROM sc GROUP BY ALL),
  e AS MATERIALIZED (SELECT dataset, conv_id, i AS child, c AS parent FROM sc WHERE score >= 0.45 UNION ALL SELECT dataset, conv_id, i, arg FROM b WHERE top < 0.45),
  a AS MATERIALIZED (SELECT dataset, conv_id, i AS child, c AS parent FROM sc WHERE score >= 0.7),
  dn AS (SELECT conv_id, child AS x FROM a UNION SELECT dn.conv_id, e.child FROM dn JOIN e ON dn.conv_id = e.conv_id AND dn.x = e.parent),
  upw AS (SELECT conv_id, parent AS x FROM a UNION SELECT upw.conv_id, e.parent FROM upw JOIN e ON upw.conv_id = e.conv_id AND upw.x = e.child),
  met AS (SELECT * FROM dn UNION SELECT * FROM upw),
  lost AS (SELECT conv_id, i FROM b WHERE top < 0.7 AND conv_id IN (SELECT conv_id FROM a) AND NOT EXISTS (SELECT 1 FROM met WHERE met.conv_id = b.conv_id AND met.x = b.i))
  SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.conv_id = e.conv_id AND lost.i = e.child)"""
)


@query("g09_anchor_prune", PRUNE)
def g09(spark, sf):
    return ch.anchor_prune(t.messages(spark, sf), event_pairs(spark, sf))


@query("g09_anchor_prune_spread", PRUNE)
def g09_spread(spark, sf):
    return ch.anchor_prune(t.messages(spark, sf), event_pairs(spark, sf), limit=0)


TRACE = MO + """, q AS (SELECT conv_id || '#' || pos AS query_id, m.* FROM msgs m WHERE pos = (SELECT max(pos) FROM msgs x WHERE x.conv_id = m.conv_id)),
  up AS (SELECT query_id, dataset, conv_id, pos, 0 AS hop FROM q UNION ALL SELECT u.query_id, u.dataset, u.conv_id, g.parent, u.hop + 1 FROM up u JOIN one g ON u.conv_id = g.conv_id AND u.pos = g.child WHERE u.hop < 10),
  k1 AS (SELECT DISTINCT u.query_id, u.dataset, u.conv_id, g.child AS pos FROM up u JOIN one g ON u.conv_id = g.conv_id AND u.pos = g.parent WHERE g.child - g.parent < 100 AND (u.query_id, g.child) NOT IN (SELECT (query_id, pos) FROM up)),
  k2 AS (SELECT DISTINCT u.query_id, u.dataset, u.conv_id, g.child AS pos FROM k1 u JOIN one g ON u.conv_id = g.conv_id AND u.pos = g.parent WHERE g.child - g.parent < 100
    AND (u.query_id, g.child) NOT IN (SELECT (query_id, pos) FROM up) AND (u.query_id, g.child) NOT IN (SELECT (query_id, pos) FROM k1))
  SELECT query_id, dataset, conv_id, pos, hop, CASE WHEN hop = 0 THEN 'query' ELSE 'direct-parent' END AS relation FROM up
  UNION ALL SELECT query_id, dataset, conv_id, pos, -1, 'thread-context' FROM k1 UNION ALL SELECT query_id, dataset, conv_id, pos, -1, 'thread-context' FROM k2"""


@query("g12_trace", TRACE)
def g12(spark, sf):
    m = t.messages(spark, sf)
    last = m.groupBy(*CONV).agg(F.max("pos").alias("pos"))
    asked = last.withColumn("query_id", F.concat_ws("#", "conv_id", F.col("pos").cast("string")))
    return ch.trace(m, single_gold(spark, sf), asked)


@query("g13_trace_by_text")
def g13(spark, sf):
    from threadloom.operators.locate import locate
    from threadloom.operators.probes import run_probes
    from threadloom.session import tune

    m = t.turns(spark, sf)
    texts = tune(spark).read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    first = locate(m, texts, F.col("author") != "system", k=1).select("query_id", *CONV, "pos")
    return ch.trace(m, run_probes(m, ["saprev"]), first)


# proposed chains: the messages of one author within a window of 300 positions
PROPOSED = """, mem AS (SELECT dataset, conv_id, (pos // 300) || ':' || author AS chain, pos FROM msgs WHERE (author::BIGINT + pos) % 3 <> 0),
  lk AS (SELECT dataset, conv_id, pos AS child, lag(pos) OVER (PARTITION BY conv_id, chain ORDER BY pos) AS parent FROM mem),
  ex AS (SELECT dataset, conv_id, child, parent FROM one WHERE child // 300 = parent // 300),
  ce AS (SELECT dataset, conv_id, child, parent FROM lk WHERE parent IS NOT NULL UNION SELECT dataset, conv_id, child, parent FROM ex)"""


def proposed(spark, sf):
    w = ch.windowed(t.messages(spark, sf)).where((F.col("author").cast("long") + F.col("pos")) % 3 != 0)
    members = w.select(*CONV, F.concat_ws(":", F.col("window").cast("string"), "author").alias("chain"), "pos")
    extra = single_gold(spark, sf).where(F.floor(F.col("child") / 300) == F.floor(F.col("parent") / 300))
    return members, extra


@query("g14_chain_edges", MO + PROPOSED + " SELECT * FROM ce")
def g14(spark, sf):
    return ch.chain_edges(*proposed(spark, sf))


@query("g15_unassigned", MO + PROPOSED + " SELECT dataset, conv_id, pos // 300 AS window, count(*) AS n FROM msgs WHERE (conv_id, pos) NOT IN (SELECT (conv_id, pos) FROM mem) GROUP BY ALL")
def g15(spark, sf):
    rest = ch.unassigned(t.messages(spark, sf), proposed(spark, sf)[0])
    return ch.windowed(rest).groupBy(*CONV, "window").agg(F.count("*").alias("n"))


@query(
    "g16_fixed_point",
    MO + PROPOSED + """, base AS (SELECT DISTINCT dataset, conv_id, child, parent FROM lk WHERE parent IS NOT NULL),
  r1 AS (SELECT * FROM one WHERE (conv_id, child) NOT IN (SELECT (conv_id, child) FROM base)),
  r2 AS (SELECT dataset, conv_id, pos AS child, pos - 1 AS parent FROM msgs WHERE pos > 0 AND conv_id IN (SELECT conv_id FROM r1)
    AND (conv_id, pos) NOT IN (SELECT (conv_id, child) FROM base) AND (conv_id, pos) NOT IN (SELECT (conv_id, child) FROM r1))
  SELECT *, 0 AS round FROM base UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2""",
)
def g16(spark, sf):
    members, _ = proposed(spark, sf)
    base = ch.chain_edges(members, single_gold(spark, sf).where("false"))
    first = single_gold(spark, sf).withColumn("round", F.lit(1))
    second = t.preds(spark, sf, ["prev1"]).select(*CONV, "child", "parent", F.lit(2).alias("round"))
    return ch.fixed_point(base, first.unionByName(second))


# the theme of a message is the user it mentions first
TH = ", th AS (SELECT dataset, conv_id, pos, m1 AS theme FROM msgs), thasof AS (SELECT dataset, conv_id, pos AS child, coalesce(lag(pos) OVER (PARTITION BY conv_id, theme ORDER BY pos), -1) AS parent FROM th)"
SAP = ", sap AS (SELECT dataset, conv_id, pos AS child, CASE WHEN pos - lp <= 100 THEN lp ELSE pos - 1 END AS parent FROM (SELECT *, lag(pos) OVER (PARTITION BY conv_id, author ORDER BY pos) AS lp FROM msgs) WHERE pos > 0), pre AS (SELECT dataset, conv_id, pos AS child, pos - 1 AS parent FROM msgs WHERE pos > 0)"


def vote_sql(*rels: str) -> str:
    rows = " UNION ALL ".join(f"SELECT dataset, conv_id, child, parent, {n} AS nth FROM {r}" for n, r in enumerate(rels))
    return f"""(SELECT dataset, conv_id, child, parent FROM (SELECT dataset, conv_id, child, parent, count(*) AS n, min(nth) AS f FROM ({rows}) WHERE child > 0 GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY conv_id, child ORDER BY n DESC, f) = 1)"""


def themed(spark, sf):
    return t.messages(spark, sf).withColumn("theme", F.get(tx.mentions("text"), F.lit(0)))


def two(spark, sf):
    m = t.messages(spark, sf)
    return [decode.filled(m, t.preds(spark, sf, [n])) for n in ("saprev", "prev1")]


@query("j11_theme_asof", M + TH + " SELECT * FROM thasof WHERE child > 0")
def j11(spark, sf):
    return ch.theme_asof(themed(spark, sf))


@query("j12_recall_sizes", M + TH + """ SELECT a.dataset, a.conv_id, a.pos, 1 + least(a.pos, 8) + count(b.pos) AS n_candidates FROM th a LEFT JOIN th b ON a.conv_id = b.conv_id AND a.theme = b.theme AND b.pos < a.pos - 8 GROUP BY a.dataset, a.conv_id, a.pos""")
def j12(spark, sf):
    return ch.recall_sizes(themed(spark, sf))


@query("w15_majority", M + TH + SAP + " SELECT * FROM " + vote_sql("thasof", "sap", "pre"))
def w15(spark, sf):
    return decode.vote(ch.theme_asof(themed(spark, sf)), *two(spark, sf))


@query("w16_novelty_roots", M + TH + SAP + " SELECT s.dataset, s.conv_id, s.child, CASE WHEN s.child = f.p THEN -1 ELSE s.parent END AS parent FROM sap s JOIN th USING (conv_id) JOIN (SELECT conv_id, theme, min(pos) AS p FROM th GROUP BY ALL) f ON f.conv_id = th.conv_id AND f.theme = th.theme WHERE th.pos = s.child")
def w16(spark, sf):
    return ch.novelty_roots(themed(spark, sf), two(spark, sf)[0])


REG = ", reg AS (SELECT dataset, conv_id, pos AS child, coalesce(lag(pos) OVER (PARTITION BY conv_id, theme ORDER BY pos), -1) AS parent FROM th WHERE pos > 0)"


@query("w17_registry_vote", M + TH + SAP + REG + " SELECT v.dataset, v.conv_id, v.child, CASE WHEN r.parent = -1 THEN -1 ELSE v.parent END AS parent FROM " + vote_sql("reg", "sap", "pre") + " v JOIN reg r USING (conv_id, child)")
def w17(spark, sf):
    reg = ch.registry(themed(spark, sf))
    voted = decode.vote(reg, *two(spark, sf))
    miss = reg.where("parent = -1").select(*CONV, "child", F.lit(True).alias("miss"))
    got = voted.join(miss, [*CONV, "child"], "left")
    return got.select(*CONV, "child", F.when(F.col("miss"), F.lit(-1).cast("long")).otherwise(F.col("parent")).alias("parent"))


@query("w18_recency_vote", M + TH + SAP + " SELECT * FROM " + vote_sql("pre", "sap", "thasof") + " WHERE parent <> -1")
def w18(spark, sf):
    voted = decode.vote(two(spark, sf)[1], two(spark, sf)[0], ch.theme_asof(themed(spark, sf)))
    ptr = voted.where("parent <> -1").select(*CONV, F.col("child").alias("node"), F.col("parent").alias("up"))
    return graph.break_cycles(ptr).select(*CONV, F.col("node").alias("child"), F.col("up").alias("parent"))


RESTR = ", rs AS (SELECT s.dataset, s.conv_id, s.child, CASE WHEN s.parent = -1 OR s.child - s.parent <= 8 OR a.theme = b.theme THEN s.parent ELSE -1 END AS parent FROM sap s JOIN th a ON a.conv_id = s.conv_id AND a.pos = s.child JOIN th b ON b.conv_id = s.conv_id AND b.pos = s.parent)"


@query("w19_agreement_vote", M + TH + SAP + RESTR + " SELECT * FROM " + vote_sql("rs", "pre", "thasof"))
def w19(spark, sf):
    m = themed(spark, sf)
    sap, pre = two(spark, sf)
    return decode.second_opinion(ch.restrict(sap, m), pre, ch.theme_asof(m))


LAYERS = MO + UPWALK + f""", {t.PREDS},
  pup AS (SELECT algorithm, dataset, conv_id, pos AS node, pos AS here, 0 AS hops FROM msgs, algs UNION ALL SELECT u.algorithm, u.dataset, u.conv_id, u.node, g.parent, u.hops + 1 FROM pup u JOIN preds g ON u.algorithm = g.algorithm AND u.conv_id = g.conv_id AND u.here = g.child),
  pl AS (SELECT algorithm, conv_id, node, count(*) AS len FROM pup GROUP BY ALL),
  gl AS (SELECT conv_id, node, count(*) AS len FROM up GROUP BY ALL),
  sh AS (SELECT p.algorithm, p.conv_id, p.node, count(*) AS n FROM pup p JOIN up g ON p.conv_id = g.conv_id AND p.node = g.node AND p.here = g.here GROUP BY ALL),
  px AS (SELECT p.algorithm, p.conv_id, p.node, count(*) AS n, count(*) FILTER (pl.len - p.hops <= 1) AS n1, count(*) FILTER (pl.len - p.hops <= 2) AS n2, count(*) FILTER (pl.len - p.hops <= 3) AS n3
    FROM pup p JOIN pl ON pl.algorithm = p.algorithm AND pl.conv_id = p.conv_id AND pl.node = p.node JOIN gl ON gl.conv_id = p.conv_id AND gl.node = p.node
    JOIN up g ON g.conv_id = p.conv_id AND g.node = p.node AND g.here = p.here AND gl.len - g.hops = pl.len - p.hops GROUP BY ALL),
  cmpc AS (SELECT pl.algorithm, pl.conv_id, pl.node, gl.len AS gl, pl.len AS pl, coalesce(sh.n, 0) AS shared, (gl.len = pl.len AND coalesce(px.n, 0) = gl.len)::INT AS em,
      coalesce(px.n1, 0) AS n1, coalesce(px.n2, 0) AS n2, coalesce(px.n3, 0) AS n3
    FROM pl JOIN gl USING (conv_id, node) LEFT JOIN sh USING (algorithm, conv_id, node) LEFT JOIN px USING (algorithm, conv_id, node)),
  cl AS (SELECT algorithm, conv_id, avg(em) AS chain_em, avg(2.0::DOUBLE * shared / (gl + pl)) AS chain_f1, avg((n1 = 1)::INT) FILTER (gl >= 1) AS prefix_1,
    coalesce(avg((n2 = 2)::INT) FILTER (gl >= 2), 0) AS prefix_2, coalesce(avg((n3 = 3)::INT) FILTER (gl >= 3), 0) AS prefix_3 FROM cmpc GROUP BY ALL),
  ev AS (SELECT n.algorithm, n.dataset, n.conv_id, count(g.child) AS n_edges_gold, count(p.child) AS n_edges_pred, count(*) FILTER (g.parent = p.parent) AS hit, avg((g.parent IS NOT DISTINCT FROM p.parent)::INT) AS edge_acc
    FROM (SELECT * FROM msgs, algs WHERE pos > 0) n LEFT JOIN one g ON g.conv_id = n.conv_id AND g.child = n.pos LEFT JOIN preds p ON p.algorithm = n.algorithm AND p.conv_id = n.conv_id AND p.child = n.pos GROUP BY ALL),
  el AS (SELECT algorithm, dataset, conv_id, n_edges_gold, n_edges_pred, hit::DOUBLE / n_edges_pred AS edge_precision, hit::DOUBLE / n_edges_gold AS edge_recall, 2.0::DOUBLE * hit / (n_edges_pred + n_edges_gold) AS edge_f1, edge_acc FROM ev),
  ly AS (SELECT el.*, chain_em, chain_f1, prefix_1, prefix_2, prefix_3, edge_acc - chain_em AS gap FROM el JOIN cl USING (algorithm, conv_id))"""

LAYER_COLS = ["edge_precision", "edge_recall", "edge_f1", "edge_acc", "chain_em", "chain_f1", "prefix_1", "prefix_2", "prefix_3", "gap"]


def layer_rows(spark, sf):
    m, g, p = t.messages(spark, sf), single_gold(spark, sf), t.preds(spark, sf)
    return layers.layers(layers.edge_layer(m, g, p, t.NAMES), layers.chain_layer(layers.chain_pairs(m, g, p, t.NAMES)))


@query("m18_edge_layer", LAYERS + " SELECT algorithm, dataset, conv_id, n_edges_gold, n_edges_pred, " + ", ".join(f"round({c}, 6) AS {c}" for c in LAYER_COLS[:4]) + " FROM el")
def m18(spark, sf):
    got = layers.edge_layer(t.messages(spark, sf), single_gold(spark, sf), t.preds(spark, sf), t.NAMES)
    return got.withColumns({c: F.round(c, 6) for c in LAYER_COLS[:4]})


@query("m19_chain_layer", LAYERS + " SELECT algorithm, dataset, conv_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in LAYER_COLS) + " FROM ly")
def m19(spark, sf):
    return layer_rows(spark, sf).select(*em.ALG, *[F.round(c, 6).alias(c) for c in LAYER_COLS])


@query("m20_exact_by_length", LAYERS + " SELECT algorithm, CASE WHEN gl < 2 THEN '1' WHEN gl <= 3 THEN '2-3' WHEN gl <= 5 THEN '4-5' WHEN gl <= 8 THEN '6-8' ELSE '9+' END AS bucket, count(*) AS n, round(avg(em), 6) AS em FROM cmpc GROUP BY ALL")
def m20(spark, sf):
    pairs = layers.chain_pairs(t.messages(spark, sf), single_gold(spark, sf), t.preds(spark, sf), t.NAMES)
    return layers.by_length(pairs).withColumn("em", F.round("em", 6))


BY_METHOD = LAYERS + ", mm AS (SELECT algorithm, '1to1' AS style, " + ", ".join(f"avg({c}) AS {c}" for c in LAYER_COLS) + " FROM ly GROUP BY 1)"


def by_method(spark, sf):
    from threadloom.operators.probes import STYLES

    rows = layer_rows(spark, sf).groupBy("algorithm").agg(*[F.avg(c).alias(c) for c in LAYER_COLS])
    style = F.create_map(*[F.lit(x) for n in t.NAMES for x in (n, STYLES[n])])
    return rows.withColumn("style", style[F.col("algorithm")])


@query("m21_by_method", BY_METHOD + " SELECT algorithm, style, " + ", ".join(f"round({c}, 6) AS {c}" for c in LAYER_COLS) + " FROM mm")
def m21(spark, sf):
    return by_method(spark, sf).withColumns({c: F.round(c, 6) for c in LAYER_COLS}).orderBy(F.desc("chain_em"))


@query("m35_by_dataset", LAYERS + " SELECT dataset, algorithm, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in LAYER_COLS) + " FROM ly GROUP BY ALL")
def m35(spark, sf):
    return layer_rows(spark, sf).groupBy("dataset", "algorithm").agg(*[F.round(F.avg(c), 6).alias(c) for c in LAYER_COLS])


@query("m36_by_style", BY_METHOD + " SELECT style, count(*) AS n_methods, round(avg(edge_acc), 6) AS edge_acc, round(avg(chain_em), 6) AS chain_em, round(avg(gap), 6) AS gap, arg_max(algorithm, (round(chain_em, 9), algorithm)) AS best FROM mm GROUP BY 1")
def m36(spark, sf):
    return layers.best_per_style(by_method(spark, sf))

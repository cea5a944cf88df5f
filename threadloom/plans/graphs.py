"""Queries: graph operators and chain-level metrics over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import chain_metrics as cm
from threadloom.operators import edge_metrics as em
from threadloom.operators import graph, paths
from threadloom.operators.threads import past_threads
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.session import materialize

GRAPH = f"WITH RECURSIVE {t.MSGS}, {t.GOLD}"

FOREST = """, up AS (SELECT conv_id, child AS pos, count(*) AS n_parents FROM gold GROUP BY ALL),
  dn AS (SELECT conv_id, parent AS pos, count(*) AS n_children FROM gold GROUP BY ALL),
  forest AS (SELECT m.dataset, m.conv_id, m.pos, coalesce(n_parents, 0) AS n_parents, coalesce(n_children, 0) AS n_children,
    coalesce(n_parents, 0) = 0 AS is_root, coalesce(n_children, 0) = 0 AS is_leaf
    FROM msgs m LEFT JOIN up USING (conv_id, pos) LEFT JOIN dn USING (conv_id, pos))"""

CLOSURE = """, clo AS (SELECT dataset, conv_id, child AS node, parent AS anc FROM gold
  UNION SELECT c.dataset, c.conv_id, c.node, g.parent FROM clo c JOIN gold g ON c.conv_id = g.conv_id AND c.anc = g.child)"""

# walks upwards from every message; long enough for every root-to-node path
WALKS = """, walk AS (SELECT dataset, conv_id, pos AS node, pos AS at, 0 AS hops FROM msgs
  UNION ALL SELECT w.dataset, w.conv_id, w.node, g.parent, w.hops + 1 FROM walk w JOIN gold g ON w.conv_id = g.conv_id AND w.at = g.child)"""


def components_sql(edges: str, name: str) -> str:
    """Smallest reachable position over undirected edges."""
    return f""", und_{name} AS (SELECT conv_id, child AS a, parent AS b FROM {edges} UNION SELECT conv_id, parent, child FROM {edges}),
  reach_{name} AS (SELECT conv_id, pos AS a, pos AS b FROM msgs
    UNION SELECT r.conv_id, r.a, u.b FROM reach_{name} r JOIN und_{name} u ON r.conv_id = u.conv_id AND r.b = u.a),
  {name} AS (SELECT conv_id, a AS pos, min(b) AS comp FROM reach_{name} GROUP BY ALL)"""


@query("g01_forest", GRAPH + FOREST + " SELECT * FROM forest")
def g01(spark, sf):
    return graph.forest(t.messages(spark, sf), t.gold(spark, sf))


@query("g02_path_counts", GRAPH + FOREST + WALKS + """ SELECT w.dataset, w.conv_id, count(*) AS n_paths FROM walk w
  JOIN forest r ON w.conv_id = r.conv_id AND w.at = r.pos AND r.is_root
  JOIN forest l ON w.conv_id = l.conv_id AND w.node = l.pos AND l.is_leaf GROUP BY ALL""")
def g02(spark, sf):
    got = cm.path_totals(t.messages(spark, sf), t.gold(spark, sf), CONV, "n_paths")
    return got.select(*CONV, cm.whole("n_paths"))


# every path with the order of its listing: the root ascending, then the largest child first
LISTED = FOREST + """, walk AS (SELECT dataset, conv_id, pos AS at, [pos] AS path, [pos] AS ord FROM forest WHERE is_root
  UNION ALL SELECT w.dataset, w.conv_id, g.child, list_append(w.path, g.child), list_append(w.ord, -g.child) FROM walk w JOIN gold g ON w.conv_id = g.conv_id AND w.at = g.parent),
  ranked AS (SELECT w.dataset, w.conv_id, row_number() OVER (PARTITION BY w.conv_id ORDER BY ord) - 1 AS rank, array_to_string(path, '-') AS path,
    count(*) OVER (PARTITION BY w.conv_id) AS n_paths FROM walk w JOIN forest f ON w.conv_id = f.conv_id AND w.at = f.pos AND f.is_leaf)"""


@query("g02_first_paths", GRAPH + LISTED + " SELECT dataset, conv_id, rank, path, n_paths, n_paths >= 2000 AS truncated FROM ranked WHERE rank < 2000")
def g02_first(spark, sf):
    got = paths.first_paths(t.messages(spark, sf), t.gold(spark, sf))
    return got.select(*CONV, "rank", F.array_join("path", "-").alias("path"), cm.whole("n_paths"), "truncated")


@query("u05_paths", GRAPH + LISTED + " SELECT conv_id, rank, path FROM ranked WHERE rank < 25")
def u05(spark, sf):
    """The table function from SQL: the first 25 paths of each conversation."""
    paths.register_paths(spark)
    steps = paths.path_steps(t.messages(spark, sf), graph.valid_edges(t.gold(spark, sf)))
    # steps that no path below the cap can take stay where they are; those from -1 tell how many paths there are
    steps.where("before < 25 OR node = -1").createOrReplaceTempView("threadloom_steps")
    return spark.sql("SELECT conv_id, rank, array_join(path, '-') AS path FROM first_paths(TABLE(threadloom_steps) PARTITION BY (dataset, conv_id) ORDER BY (node, before), 25)")


@query("g03_components", GRAPH + ", gw AS (SELECT * FROM gold WHERE child - parent <= 100)" + components_sql("gw", "comps")
       + " SELECT m.dataset, c.conv_id, c.pos, c.comp FROM comps c JOIN msgs m USING (conv_id, pos)")
def g03(spark, sf):
    return graph.components(t.messages(spark, sf), em.in_window(t.gold(spark, sf)))


@query("g03_components_spread", GRAPH + ", gw AS (SELECT * FROM gold WHERE child - parent <= 100)" + components_sql("gw", "comps")
       + " SELECT m.dataset, c.conv_id, c.pos, c.comp FROM comps c JOIN msgs m USING (conv_id, pos)")
def g03_spread(spark, sf):
    """The way large conversations take, for all of them."""
    return graph.components(t.messages(spark, sf), em.in_window(t.gold(spark, sf)), limit=0)


@query("g04_ancestor_closure", GRAPH + CLOSURE + " SELECT * FROM clo")
def g04(spark, sf):
    return graph.closure(t.messages(spark, sf), t.gold(spark, sf))


@query("g05_reply_depth", GRAPH + WALKS + " SELECT dataset, conv_id, node AS pos, max(hops)::BIGINT AS depth FROM walk GROUP BY ALL")
def g05(spark, sf):
    return graph.depth(t.messages(spark, sf), t.gold(spark, sf))


@query("g05_reply_depth_spread", GRAPH + WALKS + " SELECT dataset, conv_id, node AS pos, max(hops)::BIGINT AS depth FROM walk GROUP BY ALL")
def g05_spread(spark, sf):
    return graph.depth(t.messages(spark, sf), t.gold(spark, sf), limit=0)


@query("g06_reply_depth_from_one", GRAPH + WALKS + " SELECT dataset, conv_id, node AS pos, max(hops)::BIGINT + 1 AS depth FROM walk GROUP BY ALL")
def g06(spark, sf):
    return graph.depth(t.messages(spark, sf), t.gold(spark, sf), root=1)


@query("g10_past_threads", GRAPH + """, cut AS (SELECT conv_id, count(*) // 2 AS upto FROM msgs GROUP BY 1),
  gp AS (SELECT gold.* FROM gold JOIN cut USING (conv_id) WHERE child < upto)""" + components_sql("gp", "comps") + """
  , s AS (SELECT m.dataset, c.conv_id, c.comp, count(*) AS size, min(c.pos) AS earliest, count(DISTINCT m.author) AS n_speakers,
                 max(CASE WHEN (m.conv_id, m.pos) IN (SELECT (conv_id, child) FROM gp) THEN 1.0 ELSE 0.0 END)::DOUBLE AS max_prob
          FROM comps c JOIN msgs m ON c.conv_id = m.conv_id AND c.pos = m.pos GROUP BY ALL)
  SELECT s.dataset, c.conv_id, c.pos, c.comp AS thread, size, earliest, max_prob, n_speakers FROM comps c JOIN s ON c.conv_id = s.conv_id AND c.comp = s.comp""")
def g10(spark, sf):
    """Threads as they stood when half of each conversation's messages had come."""
    msgs = t.messages(spark, sf)
    cut = msgs.groupBy(*CONV).agg((F.count("*") / 2).cast("long").alias("upto"))
    return past_threads(msgs, t.gold(spark, sf), cut)


CONV_SQL = f"""WITH RECURSIVE {t.MSGS}, {t.GOLD}, {t.PREDS},
"""


@query("m11_fragmentation", t.EVAL + components_sql("gw", "gcomp") + components_sql("(SELECT * FROM preds WHERE algorithm = 'saprev')", "pcomp")
       + """, lab AS (SELECT g.conv_id, g.pos, g.comp AS gc, p.comp AS pc FROM gcomp g JOIN pcomp p USING (conv_id, pos)),
  sz AS (SELECT conv_id, gc, count(*) AS n FROM lab GROUP BY ALL), ov AS (SELECT conv_id, gc, pc, count(*) AS k FROM lab GROUP BY ALL),
  per AS (SELECT conv_id, gc, count(*) AS pieces, max(k)::DOUBLE / any_value(n) AS best FROM ov JOIN sz USING (conv_id, gc) WHERE n >= 2 GROUP BY ALL)
  SELECT 'saprev' AS algorithm, round(avg(pieces), 6) AS fragmentation, round(avg(best), 6) AS affinity, count(*) AS n_gold_threads FROM per""")
def m11(spark, sf):
    names = ["saprev"]
    return em.fragmentation(em.overlaps(em.labels(t.messages(spark, sf), t.gold(spark, sf), t.preds(spark, sf, names), names)))


# every edge set by algorithm in one relation: gold per algorithm, and the predictions
CHAIN = (
    f"WITH RECURSIVE {t.MSGS}, {t.GOLD}, {t.PREDS}"
    """, nodes AS (SELECT algorithm, dataset, conv_id, pos FROM msgs, algs),
  ga AS (SELECT algorithm, dataset, conv_id, child, parent FROM gold, algs),
  com AS MATERIALIZED (SELECT g.* FROM ga g JOIN preds p USING (algorithm, conv_id, child, parent)),
  gd AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM gold g WHERE g.conv_id = n.conv_id AND g.child = n.pos) AS rg,
    NOT EXISTS (SELECT 1 FROM gold g WHERE g.conv_id = n.conv_id AND g.parent = n.pos) AS lg FROM nodes n),
  ends AS MATERIALIZED (SELECT d.*, NOT EXISTS (SELECT 1 FROM preds p WHERE p.algorithm = d.algorithm AND p.conv_id = d.conv_id AND p.child = d.pos) AS rp,
    NOT EXISTS (SELECT 1 FROM preds p WHERE p.algorithm = d.algorithm AND p.conv_id = d.conv_id AND p.parent = d.pos) AS lp FROM gd d),
  gwalk AS (SELECT conv_id, pos AS node, pos AS at FROM msgs
    UNION ALL SELECT w.conv_id, w.node, g.parent FROM gwalk w JOIN gold g ON w.conv_id = g.conv_id AND w.at = g.child),
  gpaths AS (SELECT w.conv_id, count(*) AS n FROM gwalk w
    JOIN ends r ON r.algorithm = 'prev1' AND w.conv_id = r.conv_id AND w.at = r.pos AND r.rg
    JOIN ends l ON l.algorithm = 'prev1' AND w.conv_id = l.conv_id AND w.node = l.pos AND l.lg GROUP BY 1),
  ppaths AS (SELECT algorithm, conv_id, count(*) AS n FROM ends WHERE lp GROUP BY ALL),
  cwalk AS (SELECT algorithm, conv_id, pos AS node, pos AS at FROM ends WHERE lg AND lp
    UNION ALL SELECT w.algorithm, w.conv_id, w.node, c.parent FROM cwalk w JOIN com c ON w.algorithm = c.algorithm AND w.conv_id = c.conv_id AND w.at = c.child),
  cpaths AS (SELECT w.algorithm, w.conv_id, count(*) AS n FROM cwalk w
    JOIN ends r ON w.algorithm = r.algorithm AND w.conv_id = r.conv_id AND w.at = r.pos AND r.rg AND r.rp GROUP BY ALL),
  gclo AS (SELECT conv_id, child AS node, parent AS anc FROM gold
    UNION SELECT c.conv_id, c.node, g.parent FROM gclo c JOIN gold g ON c.conv_id = g.conv_id AND c.anc = g.child),
  pclo AS (SELECT algorithm, conv_id, child AS node, parent AS anc FROM preds
    UNION ALL SELECT c.algorithm, c.conv_id, c.node, p.parent FROM pclo c JOIN preds p ON c.algorithm = p.algorithm AND c.conv_id = p.conv_id AND c.anc = p.child),
  ng AS (SELECT conv_id, node, count(*) AS n FROM gclo GROUP BY ALL),
  np AS (SELECT algorithm, conv_id, node, count(*) AS n FROM pclo GROUP BY ALL),
  nb AS (SELECT p.algorithm, p.conv_id, p.node, count(*) AS n FROM pclo p JOIN gclo g USING (conv_id, node, anc) GROUP BY ALL),
  jac AS (SELECT a.algorithm, ng.conv_id, ng.node, coalesce(nb.n, 0)::DOUBLE / (ng.n + coalesce(np.n, 0) - coalesce(nb.n, 0)) AS j
    FROM ng CROSS JOIN algs a LEFT JOIN np ON np.algorithm = a.algorithm AND np.conv_id = ng.conv_id AND np.node = ng.node
    LEFT JOIN nb ON nb.algorithm = a.algorithm AND nb.conv_id = ng.conv_id AND nb.node = ng.node),
  m3 AS (SELECT algorithm, conv_id, sum(j) AS js, count(*) AS nj FROM jac GROUP BY ALL),
  gund AS (SELECT conv_id, child AS a, parent AS b FROM gold UNION SELECT conv_id, parent, child FROM gold),
  greach AS (SELECT conv_id, pos AS a, pos AS b FROM msgs UNION SELECT r.conv_id, r.a, u.b FROM greach r JOIN gund u ON r.conv_id = u.conv_id AND r.b = u.a),
  gcomp AS (SELECT conv_id, a AS pos, min(b) AS gc FROM greach GROUP BY ALL),
  pcomp AS (SELECT n.algorithm, n.conv_id, n.pos, least(n.pos, coalesce(min(anc), n.pos)) AS pc FROM nodes n
    LEFT JOIN pclo p ON p.algorithm = n.algorithm AND p.conv_id = n.conv_id AND p.node = n.pos GROUP BY 1, 2, 3),
  lab AS (SELECT * FROM pcomp JOIN gcomp USING (conv_id, pos)),
  sg AS (SELECT algorithm, conv_id, gc, count(*) AS n FROM lab GROUP BY ALL),
  sp AS (SELECT algorithm, conv_id, pc, count(*) AS n FROM lab GROUP BY ALL),
  ov AS (SELECT algorithm, conv_id, gc, pc, count(*) AS n FROM lab GROUP BY ALL),
  ex AS (SELECT algorithm, conv_id, count(*) FILTER (ov.n = sg.n AND ov.n = sp.n) AS n_exact,
    count(*) FILTER (ov.n = sg.n AND ov.n = sp.n AND ov.n > 1) AS n_exact_multi FROM ov JOIN sg USING (algorithm, conv_id, gc) JOIN sp USING (algorithm, conv_id, pc) GROUP BY ALL),
  cg AS (SELECT algorithm, conv_id, count(*) AS n, count(*) FILTER (n > 1) AS nm FROM sg GROUP BY ALL),
  cp AS (SELECT algorithm, conv_id, count(*) AS n, count(*) FILTER (n > 1) AS nm FROM sp GROUP BY ALL),
  cnt AS (SELECT n.algorithm, n.dataset, n.conv_id, count(*) AS n_msgs, any_value(eg.n) AS n_gold_edges, any_value(ep.n) AS n_pred_edges,
      any_value(g.n) AS n_gold_paths, any_value(p.n) AS n_pred_paths, coalesce(any_value(c.n), 0) AS n_shared_paths, any_value(cg.n) AS n_gold_components,
      any_value(cp.n) AS n_pred_components, any_value(ex.n_exact) AS n_exact, any_value(cg.nm) AS n_gold_components_multi, any_value(cp.nm) AS n_pred_components_multi,
      any_value(ex.n_exact_multi) AS n_exact_multi, any_value(m3.js) AS jaccard_sum, any_value(m3.nj) AS n_anc_msgs
    FROM nodes n JOIN gpaths g USING (conv_id) JOIN ppaths p USING (algorithm, conv_id) LEFT JOIN cpaths c USING (algorithm, conv_id)
    JOIN (SELECT conv_id, count(*) AS n FROM gold GROUP BY 1) eg USING (conv_id) JOIN (SELECT algorithm, conv_id, count(*) AS n FROM preds GROUP BY ALL) ep USING (algorithm, conv_id)
    JOIN cg USING (algorithm, conv_id) JOIN cp USING (algorithm, conv_id) JOIN ex USING (algorithm, conv_id) JOIN m3 USING (algorithm, conv_id) GROUP BY ALL)"""
)

RATIOS = """n_msgs, n_gold_edges, n_pred_edges, n_gold_paths, n_pred_paths, n_shared_paths,
  round(100.0 * n_shared_paths::DOUBLE / n_pred_paths, 6) AS path_p, round(100.0 * n_shared_paths::DOUBLE / n_gold_paths, 6) AS path_r,
  CASE WHEN n_shared_paths > 0 THEN round(200.0 * n_shared_paths::DOUBLE / (n_gold_paths + n_pred_paths), 6) END AS path_f1,
  CASE WHEN n_shared_paths > 0 THEN round(200.0 * n_shared_paths::DOUBLE / (n_gold_paths + n_pred_paths), 6) ELSE 0.0 END AS path_f1_zero_filled,
  n_gold_paths >= 2000 AS gold_truncated, n_pred_paths >= 2000 AS pred_truncated,
  round(100.0 * n_exact::DOUBLE / n_gold_components, 6) AS component_recall, round(100.0 * n_exact::DOUBLE / n_pred_components, 6) AS component_precision,
  n_gold_components, n_pred_components, n_exact, n_gold_components_multi, n_pred_components_multi, n_exact_multi,
  CASE WHEN n_pred_components_multi > 0 THEN round(n_exact_multi::DOUBLE / n_pred_components_multi, 6) END AS component_exact_rate,
  round(100.0 * jaccard_sum / n_anc_msgs, 6) AS ancestor_jaccard, round(jaccard_sum, 6) AS jaccard_sum, n_anc_msgs"""

FRACTIONS = ["path_p", "path_r", "path_f1", "path_f1_zero_filled", "component_recall", "component_precision", "component_exact_rate", "ancestor_jaccard", "jaccard_sum"]


def rounded(df, cols=FRACTIONS):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def chain_rows(spark, sf):
    return cm.per_conversation(t.messages(spark, sf), t.gold(spark, sf), t.preds(spark, sf), t.NAMES)


@query("m12_chain_metrics", CHAIN + f" SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt")
def m12(spark, sf):
    return rounded(chain_rows(spark, sf))


SUMMED = "SELECT algorithm, dataset, " + ", ".join(
    f"sum({c}) AS {c}" if c == "jaccard_sum" else f"sum({c})::BIGINT AS {c}" for c in cm.COUNT_COLS
) + " FROM cnt GROUP BY ALL"


@query("m13_chain_metrics_micro", CHAIN + f", s AS ({SUMMED}) SELECT algorithm, dataset, {RATIOS} FROM s")
def m13(spark, sf):
    return rounded(cm.pooled(t.messages(spark, sf), t.gold(spark, sf), t.preds(spark, sf), t.NAMES))


POOLED = """, e AS (SELECT algorithm, 'g' AS side, conv_id, child, parent FROM gold, algs UNION ALL SELECT algorithm, 'p', conv_id, child, parent FROM preds),
  n AS (SELECT algorithm, side, dataset, conv_id, pos FROM msgs, algs, (SELECT unnest(['g', 'p']) AS side)),
  w AS (SELECT n.*, [pos] AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.algorithm = n.algorithm AND e.side = n.side AND e.conv_id = n.conv_id AND e.child = n.pos)
    UNION ALL SELECT w.algorithm, w.side, w.dataset, w.conv_id, e.child, list_append(w.path, e.child) FROM w JOIN e ON e.algorithm = w.algorithm AND e.side = w.side AND e.conv_id = w.conv_id AND e.parent = w.pos),
  tuples AS (SELECT algorithm, dataset, path, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM w
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.algorithm = w.algorithm AND e.side = w.side AND e.conv_id = w.conv_id AND e.parent = w.pos) GROUP BY ALL),
  np2 AS (SELECT algorithm, dataset, count(*) FILTER (g) AS n_gold_paths, count(*) FILTER (p) AS n_pred_paths, count(*) FILTER (g AND p) AS n_shared_paths FROM tuples GROUP BY ALL),
  sets AS (SELECT algorithm, 'g' AS side, conv_id, list(pos ORDER BY pos) AS l FROM gcomp, algs GROUP BY algorithm, conv_id, gc
    UNION ALL SELECT algorithm, 'p', conv_id, list(pos ORDER BY pos) FROM pcomp GROUP BY algorithm, conv_id, pc),
  both2 AS (SELECT algorithm, dataset, l, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM sets JOIN (SELECT DISTINCT dataset, conv_id FROM msgs) USING (conv_id) GROUP BY ALL),
  nc2 AS (SELECT algorithm, dataset, count(*) FILTER (g) AS n_gold_components, count(*) FILTER (p) AS n_pred_components, count(*) FILTER (g AND p) AS n_exact FROM both2 GROUP BY ALL),
  rest AS (SELECT algorithm, dataset, sum(jaccard_sum) AS js, sum(n_anc_msgs)::BIGINT AS n_anc_msgs, count(*) FILTER (n_gold_paths >= 2000 OR n_pred_paths >= 2000) AS truncated_convs FROM cnt GROUP BY ALL)
  SELECT algorithm, dataset, n_gold_paths, n_pred_paths, n_shared_paths, round(100.0 * n_shared_paths / n_pred_paths, 6) AS path_p, round(100.0 * n_shared_paths / n_gold_paths, 6) AS path_r,
    CASE WHEN n_shared_paths > 0 THEN round(200.0 * n_shared_paths / (n_gold_paths + n_pred_paths), 6) ELSE 0.0 END AS path_f1, n_gold_components, n_pred_components, n_exact,
    round(100.0 * n_exact / n_gold_components, 6) AS component_recall, round(100.0 * n_exact / n_pred_components, 6) AS component_precision,
    round(100.0 * js / n_anc_msgs, 6) AS ancestor_jaccard, n_anc_msgs, truncated_convs
  FROM np2 JOIN nc2 USING (algorithm, dataset) JOIN rest USING (algorithm, dataset)"""


@query("m13_pooled", CHAIN + POOLED)
def m13_sets(spark, sf):
    """Paths and components as sets that forget the conversation."""
    got = cm.pooled_sets(t.messages(spark, sf), t.gold(spark, sf), t.preds(spark, sf), t.NAMES)
    return rounded(got, ["path_p", "path_r", "path_f1", "component_recall", "component_precision", "ancestor_jaccard"])


MACRO = ", ".join(f"round(avg({c}), 6) AS {c}" for c in FRACTIONS[:-1])


@query("m16_chain_metrics_macro", CHAIN + f", r AS (SELECT algorithm, dataset, conv_id, {RATIOS} FROM cnt) SELECT algorithm, dataset, count(*) AS n_conv, {MACRO} FROM r GROUP BY ALL")
def m16(spark, sf):
    return cm.macro(chain_rows(spark, sf))

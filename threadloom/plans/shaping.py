"""Queries: filters, normalisation, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import normalize as nz
from threadloom.operators.blocks import band_pairs
from threadloom.operators.probes import run_probes
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.session import tune
from threadloom.sources.events import micros

M = f"WITH {t.MSGS}"
MG = f"WITH {t.MSGS}, {t.GOLD}"


@query(
    "p02_self_links",
    M + """, lp AS (SELECT *, lag(pos) OVER (PARTITION BY conv_id, author ORDER BY pos) AS p FROM msgs),
  b2 AS (SELECT dataset, conv_id, pos, CASE WHEN pos - p <= 100 THEN p ELSE pos END AS parent FROM lp)
  SELECT dataset, conv_id, pos, count(*) FILTER (pos <> parent) AS n_replies, bool_or(pos = parent) AS is_root FROM b2 GROUP BY ALL""",
)
def p02(spark, sf):
    return nz.self_links(run_probes(t.messages(spark, sf), ["b2_speaker"]))


@query(
    "p03_drop_context",
    M + """, k AS (SELECT * FROM msgs WHERE author <> '0' AND pos >= 100)
  SELECT dataset, conv_id, pos, msg_id FROM k WHERE conv_id IN (SELECT conv_id FROM k GROUP BY 1 HAVING count(*) >= 20)""",
)
def p03(spark, sf):
    # author 0 stands in for the system account; the first 100 lines are context
    got = nz.drop_context(t.messages(spark, sf), F.col("author") == "0", context=100)
    return got.select(*CONV, "pos", "msg_id")


@query(
    "p04_source_filter",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts IS NOT NULL AND event_type IN ('click', 'view', 'purchase') GROUP BY 1",
)
def p04(spark, sf):
    ev = tune(spark).read.parquet(f"{sf}/events.parquet")
    kept = ev.where(F.col("ts").isNotNull() & F.col("event_type").isin("click", "view", "purchase"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "p05_minimum_size",
    MG + """, a AS (SELECT conv_id FROM msgs GROUP BY 1 HAVING count(*) >= 30), b AS (SELECT conv_id FROM gold GROUP BY 1 HAVING count(DISTINCT child) >= 10)
  SELECT dataset, conv_id, count(*) AS n_msgs FROM msgs WHERE conv_id IN (SELECT conv_id FROM a) AND conv_id IN (SELECT conv_id FROM b) GROUP BY ALL""",
)
def p05(spark, sf):
    kept = nz.min_parented(nz.min_size(t.messages(spark, sf), 30), t.gold(spark, sf), 10)
    return kept.groupBy(*CONV).agg(F.count("*").alias("n_msgs"))


@query(
    "p06_bright_region",
    MG + """, k AS (SELECT dataset, conv_id, pos AS old_pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos
    FROM msgs WHERE (conv_id, pos) IN (SELECT (conv_id, child) FROM gold))
  SELECT g.dataset, g.conv_id, a.pos AS child, b.pos AS parent FROM gold g JOIN k a ON g.conv_id = a.conv_id AND g.child = a.old_pos
  JOIN k b ON g.conv_id = b.conv_id AND g.parent = b.old_pos""",
)
def p06(spark, sf):
    return nz.bright_region(t.messages(spark, sf), t.gold(spark, sf))[1]


@query(
    "p07_truncate",
    MG + """, s AS (SELECT conv_id, greatest(count(*) - 300, 0) AS d FROM msgs GROUP BY 1)
  SELECT dataset, g.conv_id, child - d AS child, parent - d AS parent FROM gold g JOIN s USING (conv_id) WHERE parent >= d AND child >= d""",
)
def p07(spark, sf):
    return nz.truncate(t.messages(spark, sf), t.gold(spark, sf), 300)[1]


@query(
    "p08_dangling_parents",
    M + """ SELECT m.dataset, m.conv_id, m.msg_id, p.msg_id AS parent_id FROM msgs m LEFT JOIN msgs p
    ON m.conv_id = p.conv_id AND p.msg_id = m.msg_id - CAST(m.m1 AS BIGINT) - 1""",
)
def p08(spark, sf):
    first = F.get(tx.mentions("text"), F.lit(0)).cast("long")
    rows = t.messages(spark, sf).select(*CONV, "msg_id", (F.col("msg_id") - first - 1).alias("parent_id"))
    return nz.repair_parents(rows).select(*CONV, "msg_id", "parent_id")


@query(
    "p09_largest_until",
    M + """, s AS (SELECT dataset, conv_id, count(*) AS n_msgs FROM msgs GROUP BY ALL HAVING count(*) >= 30),
  r AS (SELECT *, coalesce(sum(n_msgs) OVER (ORDER BY -n_msgs, dataset, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM s)
  SELECT * FROM r WHERE n_before < 3000""",
)
def p09(spark, sf):
    return nz.largest_until(t.messages(spark, sf), budget=3000)


@query(
    "p10_first_conversations",
    M + """ SELECT dataset, conv_id, count(*) AS n_msgs FROM msgs WHERE conv_id IN (SELECT DISTINCT conv_id FROM msgs ORDER BY 1 LIMIT 7) GROUP BY ALL""",
)
def p10(spark, sf):
    return nz.first_conversations(t.messages(spark, sf), 7).groupBy(*CONV).agg(F.count("*").alias("n_msgs"))


@query("p11_text_limit", "SELECT doc_id, substring(text, 1, 300) AS text, least(length(text), 300) AS n FROM documents")
def p11(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet")
    short = F.substring("text", 1, 300)
    return docs.select("doc_id", short.alias("text"), F.length(short).cast("long").alias("n"))


@query(
    "p12_strip_html",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def p12(spark, sf):
    pages = tune(spark).read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", tx.strip_html("html").alias("text"))


@query(
    "p13_time_buckets",
    """SELECT event_type, epoch_us(ts) // 604800000000 AS week, strftime(ts, '%Y-%m-%d') AS day,
    concat_ws('/', 'main', event_type, strftime(ts, '%Y-%m-%d')) AS day_conv, count(*) AS n FROM events GROUP BY ALL""",
)
def p13(spark, sf):
    ev = tune(spark).read.parquet(f"{sf}/events.parquet")
    day = F.date_format("ts", "yyyy-MM-dd")
    keyed = ev.select(
        "event_type",
        F.floor(micros("ts") / 604_800_000_000).alias("week"),
        day.alias("day"),
        F.concat_ws("/", F.lit("main"), "event_type", day).alias("day_conv"),
    )
    return keyed.groupBy("event_type", "week", "day", "day_conv").agg(F.count("*").alias("n"))


def md5_mod_sql(expr: str, n: int) -> str:
    part = lambda a: f"CAST('0x' || substr(md5({expr}), {a}, 16) AS UBIGINT)::HUGEINT"
    return f"CAST(({part(1)} % {n} * ({2**64 % n}) + {part(17)} % {n}) % {n} AS BIGINT)"


SPLIT = f"""CASE WHEN {md5_mod_sql("conv_id || '|42'", 100)} < 70 THEN 'train' WHEN {md5_mod_sql("conv_id || '|42'", 100)} < 85 THEN 'dev' ELSE 'test' END"""


@query(
    "p16_split",
    f"SELECT conv_id::VARCHAR AS conv_id, {SPLIT.replace('conv_id', 'conv_id::VARCHAR')} AS split, {md5_mod_sql('conv_id::VARCHAR || ' + chr(39) + '|42' + chr(39), 5)} AS fold FROM conversations GROUP BY ALL",
)
def p16(spark, sf):
    convs = t.turns(spark, sf).select("conv_id").distinct()
    return convs.select("conv_id", nz.split_of("conv_id").alias("split"), nz.fold_of("conv_id").alias("fold"))


@query(
    "p17_decision_rows",
    t.EVAL + """, pm AS (SELECT dataset, conv_id, child, string_agg(CASE WHEN in_gold THEN parent::VARCHAR END, ',' ORDER BY parent) AS g,
      string_agg(CASE WHEN in_pred THEN parent::VARCHAR END, ',' ORDER BY parent) AS p, count(*) FILTER (in_gold AND in_pred) AS n_hit, count(*) AS n_any
      FROM cmp WHERE algorithm = 'saprev' GROUP BY ALL)
  SELECT m.dataset, m.conv_id, m.pos AS child, coalesce(g, '') AS gold_parents, coalesce(p, '') AS pred_parents, coalesce(n_hit, 0) AS n_hit,
    CASE WHEN n_any > 0 THEN round(n_hit::DOUBLE / n_any, 6) END AS jaccard, true AS has_mention FROM msgs m LEFT JOIN pm ON m.conv_id = pm.conv_id AND m.pos = pm.child""",
)
def p17(spark, sf):
    c = t.compared(spark, sf, ["saprev"])
    join = lambda flag: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.col("parent")))), lambda p: p.cast("string")), ","
    )
    both = F.count_if(F.col("in_gold") & F.col("in_pred"))
    rows = c.groupBy(*CONV, F.col("child").alias("pos")).agg(
        join("in_gold").alias("gold_parents"), join("in_pred").alias("pred_parents"), both.alias("n_hit"), F.count("*").alias("n_any")
    )
    msgs = t.messages(spark, sf).select(*CONV, "pos", F.contains("text", F.lit("<@")).alias("has_mention"))
    out = msgs.join(rows, [*CONV, "pos"], "left").na.fill("", ["gold_parents", "pred_parents"]).na.fill(0, ["n_hit"])
    return out.select(
        *CONV, F.col("pos").alias("child"), "gold_parents", "pred_parents", "n_hit",
        F.round(F.try_divide("n_hit", "n_any"), 6).alias("jaccard"), "has_mention",
    )


@query(
    "p18_same_speaker_pairs",
    M + """ SELECT a.dataset, a.conv_id, count(*) AS n_pairs, count(*) FILTER (lower(trim(a.author)) = lower(trim(b.author))) AS n_same
  FROM msgs a JOIN msgs b ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 100 GROUP BY 1, 2""",
)
def p18(spark, sf):
    m = t.messages(spark, sf)
    side = lambda p, s: m.select(*CONV, F.col("pos").alias(p), tx.speaker("author").alias(s))
    pairs = band_pairs(side("i", "si"), side("c", "sc"))
    return pairs.groupBy(*CONV).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("si") == F.col("sc")).alias("n_same"))


@query(
    "k02_stable_sort",
    """SELECT conv_id::VARCHAR AS conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN length(text) ELSE 0 END, turn) - 1 AS pos
  FROM conversations""",
)
def k02(spark, sf):
    # the time of a message is unknown (0) unless a user wrote it; the original index breaks ties
    m = t.turns(spark, sf).withColumn("when", F.when(F.col("author") == "user", F.length("text")))
    rows = m.drop("pos").withColumn("when", F.coalesce("when", F.lit(0)))
    return nz.positions(rows, ["when", "msg_id"]).select("conv_id", F.col("msg_id").alias("turn"), "pos")


@query(
    "k03_top_per_group",
    """SELECT * FROM (SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank
  FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) WHERE n >= 10) WHERE rank <= 40""",
)
def k03(spark, sf):
    ev = tune(spark).read.parquet(f"{sf}/events.parquet")
    counts = ev.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return nz.top_per_group(counts, "event_type", "n", "user_id", 40, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "k04_edge_set_algebra",
    f"""WITH {t.MSGS}, {t.PREDS}, a AS (SELECT dataset, child, parent FROM preds WHERE algorithm = 'prev1'), b AS (SELECT dataset, child, parent FROM preds WHERE algorithm = 'saprev')
  SELECT dataset, 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1 UNION ALL
  SELECT dataset, 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1 UNION ALL
  SELECT dataset, 'except', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1""",
)
def k04(spark, sf):
    # pooled over the conversations of a dataset: equal position pairs merge
    p = t.preds(spark, sf)
    a = p.where("algorithm = 'prev1'").select("dataset", "child", "parent")
    b = p.where("algorithm = 'saprev'").select("dataset", "child", "parent")
    count = lambda df, op: df.groupBy("dataset").agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return (
        count(a.union(b).distinct(), "union")
        .unionByName(count(a.intersect(b), "intersect"))
        .unionByName(count(b.subtract(a), "except"))
    )


@query(
    "k06_distinct_mentions",
    M + " SELECT dataset, conv_id, pos, CASE WHEN m1 = m2 THEN 1 ELSE 2 END AS n_distinct FROM msgs",
)
def k06(spark, sf):
    got = t.messages(spark, sf).select(*CONV, "pos", F.size(F.array_distinct(tx.mentions("text"))).alias("n_distinct"))
    return got


@query(
    "k07_parent_table",
    f"""WITH {t.MSGS}, {t.PREDS} SELECT algorithm, dataset, conv_id, child, string_agg(DISTINCT parent::VARCHAR, ',' ORDER BY parent::VARCHAR) AS parents
  FROM preds WHERE child <> parent GROUP BY ALL""",
)
def k07(spark, sf):
    splits = [t.preds(spark, sf).where(nz.split_of("conv_id") == s) for s in ("train", "dev", "test")]
    return nz.parent_table(splits[0].unionByName(splits[1]).unionByName(splits[2]))


@query("a18_pending_work", M + """ SELECT DISTINCT dataset, conv_id FROM msgs WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT conv_id FROM msgs GROUP BY 1 HAVING count(*) >= 450) d WHERE d.conv_id = msgs.conv_id)""")
def a18(spark, sf):
    m = t.messages(spark, sf)
    return nz.pending(m.select(*CONV).distinct(), nz.min_size(m, 450), CONV)


@query("f23_pseudonyms", M + """ SELECT dataset, conv_id, pos, 'u_' || substr(sha256('pepper' || author), 1, 8) AS author, '<REDACTED>' AS text FROM msgs""")
def f23(spark, sf):
    m = t.messages(spark, sf)
    return m.select(*CONV, "pos", tx.pseudonym("author", "pepper").alias("author"), F.lit("<REDACTED>").alias("text"))

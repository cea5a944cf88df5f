"""Queries: candidate pairs, text probes, decoders and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.vectors import hash_vectors, with_hash_vector
from threadloom.operators import decode, pairs
from threadloom.operators.normalize import positions
from threadloom.operators.probes import PROBES, run_probes
from threadloom.operators.similarity_probes import simmax  # noqa: F401  registers the text probes
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.plans.shaping import md5_mod_sql
from threadloom.schema import CONV
from threadloom.session import tune
from threadloom.sources.events import prepared, with_mentions

MP = f"""WITH {t.MSGS}, {t.GOLD},
  pairs AS (SELECT a.dataset, a.conv_id, a.pos AS i, b.pos AS c, a.author AS ia, b.author AS ca, a.m1, a.m2, a.ts_us AS it, b.ts_us AS ct,
    length(a.text) AS il, length(b.text) AS cl FROM msgs a JOIN msgs b ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 100),
  sc AS (SELECT dataset, conv_id, i, c, (1 + 40 * (ia = ca)::INT::DOUBLE + 15 * (ca = m1 OR ca = m2)::INT::DOUBLE) / (56.0::DOUBLE * (i - c)) AS score FROM pairs)"""


def event_pairs(spark, sf):
    return pairs.scored(with_mentions(t.messages(spark, sf)))


@query(
    "j04_pair_labels",
    MP + """ SELECT p.dataset, p.conv_id, count(*) AS n_pairs, count(g.child) AS n_positive FROM pairs p
  LEFT JOIN gold g ON p.conv_id = g.conv_id AND p.i = g.child AND p.c = g.parent
  WHERE (p.conv_id, p.i) IN (SELECT (conv_id, child) FROM gold) GROUP BY 1, 2""",
)
def j04(spark, sf):
    gold = t.gold(spark, sf)
    got = pairs.label(pairs.candidates(t.messages(spark, sf), gold=gold), gold)
    return got.groupBy(*CONV).agg(F.count("*").alias("n_pairs"), F.sum("label").alias("n_positive"))


FEAT_SQL = """avg((ia = ca AND ia <> '')::INT) AS same_author, avg(ln(1 + (i - c)::DOUBLE)) AS log_gap, avg(ln(1 + greatest((it - ct) / 1e6, 0))) AS log_seconds,
  avg(1.0) AS has_ts, avg(ln(1 + abs(il - cl)::DOUBLE)) AS log_len_diff, avg(ln((i - c)::DOUBLE)) AS log_between"""


@query(
    "f04_pair_features",
    MP + f""", f AS (SELECT dataset, conv_id, {FEAT_SQL} FROM pairs GROUP BY 1, 2)
  SELECT dataset, conv_id, round(same_author, 6) AS same_author, round(log_gap, 6) AS log_gap, round(log_seconds, 6) AS log_seconds,
    round(has_ts, 6)::DOUBLE AS has_ts, round(log_len_diff, 6) AS log_len_diff, round(log_between, 6) AS log_between FROM f""",
)
def f04(spark, sf):
    m = t.messages(spark, sf).withColumn("n_chars", F.length("text"))
    cols = ["author", "ts_us", "n_chars"]
    f = pairs.features(pairs.candidates(m, cols, cols))
    return f.groupBy(*CONV).agg(*[F.round(F.avg(c), 6).alias(c) for c in pairs.FEATURES])


def vector_messages(spark, sf):
    """embeddings -> messages: one conversation per label, in order of the vector id."""

    def build():
        e = tune(spark).read.parquet(f"{sf}/embeddings.parquet")
        rows = e.select(
            F.lit("vectors").alias("dataset"), F.col("label").cast("string").alias("conv_id"),
            F.col("vec_id").alias("msg_id"), F.col("embedding").alias("vec"),
        )
        return positions(rows, ["msg_id"])

    return prepared(spark, ("vectors", sf), build)


VEC = """WITH v AS (SELECT 'vectors' AS dataset, label::VARCHAR AS conv_id, vec_id AS msg_id, embedding::DOUBLE[] AS vec,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
  p AS (SELECT a.dataset, a.conv_id, a.pos AS i, b.pos AS c, list_inner_product(a.vec, b.vec) AS dot FROM v a JOIN v b
    ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 100)"""


@query(
    "w03_simmax",
    VEC + """ SELECT dataset, conv_id, i AS child, c AS parent, round(dot, 6) AS score FROM p
  QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY dot DESC, c) = 1""",
)
def w03(spark, sf):
    return pairs.most_similar(vector_messages(spark, sf)).withColumn("score", F.round("score", 6))


@query("f05_pair_dot", VEC + " SELECT dataset, conv_id, i, c, round(dot, 6) AS dot FROM p")
def f05(spark, sf):
    return pairs.pair_dots(vector_messages(spark, sf)).select(*CONV, "i", "c", F.round("dot", 6).alias("dot"))


@query("w03_simmax_text")
def w03_text(spark, sf):
    return pairs.most_similar(with_hash_vector(t.turns(spark, sf)))


@query("u01_all_probes")
def u01(spark, sf):
    """Every registered probe over the same turns: messages, predicted roots, and mean distance."""
    names = sorted(PROBES)
    got = run_probes(t.turns(spark, sf), names)
    root = F.col("child") == F.col("parent")
    return got.groupBy("algorithm").agg(
        F.countDistinct(F.struct("conv_id", "child")).alias("n_messages"), F.count_if(root).alias("n_self"),
        F.round(F.avg(F.when(~root, F.col("child") - F.col("parent"))), 6).alias("mean_distance"),
    )


BL = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQUEEZED = f"regexp_replace(lower(text), '{BL}+', '', 'g')"
WORDS = f"list_filter(string_split_regex(lower(text), '{BL}+'), lambda w: w <> '')"


@query(
    "f01_grams",
    f"""WITH s AS (SELECT doc_id, {SQUEEZED} AS t FROM documents),
  g AS (SELECT DISTINCT doc_id, substring(t, k, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS k FROM s WHERE length(t) >= 3)
    UNION SELECT doc_id, t FROM s WHERE length(t) BETWEEN 1 AND 2)
  SELECT gram, count(*) AS n_docs, min(doc_id) AS first_doc FROM g GROUP BY 1""",
)
def f01(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.explode(tx.grams("text")).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(
    "f02_md5_buckets",
    f"""WITH s AS (SELECT doc_id, {SQUEEZED} AS t FROM documents),
  g AS (SELECT DISTINCT doc_id, substring(t, k, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS k FROM s WHERE length(t) >= 3)
    UNION SELECT doc_id, t FROM s WHERE length(t) BETWEEN 1 AND 2),
  u AS (SELECT gram, count(*) AS n FROM g GROUP BY 1)
  SELECT {md5_mod_sql('gram', 20000)} AS bucket, sum(n)::BIGINT AS n, count(*) AS n_grams FROM u GROUP BY 1""",
)
def f02(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet")
    # count grams first, so that each distinct gram is hashed once
    per_gram = docs.select(F.explode(tx.grams("text")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return per_gram.groupBy(tx.md5_bucket("gram").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("n_grams"))


@query("f03_hash_vectors")
def f03(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet")
    return hash_vectors(docs, ["doc_id"])


TFIDF = f"""tok AS (SELECT conv_id::VARCHAR AS conv_id, pos, role, text, {WORDS} AS ws FROM
    (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)),
  tf AS (SELECT conv_id, pos, w AS word, count(*) AS tf FROM (SELECT conv_id, pos, unnest(ws) AS w FROM tok) GROUP BY ALL),
  idf AS (SELECT word, ln((1 + (SELECT count(*) FROM tok))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
  wt AS (SELECT conv_id, pos, word, tf * idf AS w FROM tf JOIN idf USING (word)),
  nm AS (SELECT conv_id, pos, sqrt(sum(w * w)) AS n FROM wt GROUP BY ALL),
  cosn AS (SELECT a.conv_id, a.pos AS i, b.pos AS c, sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)) AS cosine, count(*) AS n_shared
    FROM wt a JOIN wt b ON a.conv_id = b.conv_id AND a.word = b.word AND b.pos < a.pos AND b.pos >= a.pos - 100
    JOIN nm na ON na.conv_id = a.conv_id AND na.pos = a.pos JOIN nm nb ON nb.conv_id = b.conv_id AND nb.pos = b.pos GROUP BY ALL)"""


@query("f07_tfidf", f"WITH {TFIDF} SELECT conv_id, pos, word, round(w, 6) AS weight, round(n, 6) AS norm FROM wt JOIN nm USING (conv_id, pos)")
def f07(spark, sf):
    m = t.turns(spark, sf)
    w = pairs.weigh(m, pairs.fit_idf(m), [*CONV, "pos"])
    return w.select("conv_id", "pos", "word", F.round("weight", 6).alias("weight"), F.round("norm", 6).alias("norm"))


@query(
    "f08_token_overlap",
    f"""WITH d AS (SELECT item_id, list_distinct({WORDS}) AS ws FROM benchmark)
  SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ws, b.ws))::DOUBLE / least(len(a.ws), len(b.ws)), 6) AS overlap
  FROM d a JOIN d b ON b.item_id = a.item_id + 1""",
)
def f08(spark, sf):
    d = tune(spark).read.parquet(f"{sf}/benchmark.parquet").select("item_id", tx.words("text").alias("ws"))
    nxt = d.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("ws2"))
    got = d.join(nxt, "item_id")
    return got.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(tx.token_overlap(F.col("ws"), F.col("ws2")), 6).alias("overlap"))


@query(
    "f09_mentions",
    f"WITH {t.MSGS} SELECT dataset, conv_id, pos, m1 AS first, m2 AS second FROM msgs",
)
def f09(spark, sf):
    got = tx.mentions("text", tx.MENTION_LOOSE)
    return t.messages(spark, sf).select(*CONV, "pos", F.get(got, F.lit(0)).alias("first"), F.get(got, F.lit(1)).alias("second"))


@query(
    "w07_b4_tfidf",
    f"""WITH {TFIDF}, s AS (SELECT *, cosine / (1 + 0.02 * (i - c)) AS score FROM cosn),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, c DESC) = 1)
  SELECT 'turns' AS dataset, t.conv_id, t.pos AS child, CASE WHEN score >= 0.02 THEN c ELSE t.pos END AS parent FROM tok t LEFT JOIN b ON t.conv_id = b.conv_id AND t.pos = b.i""",
)
def w07(spark, sf):
    m = t.turns(spark, sf)
    return decode.cosine_decay(pairs.shared_words(pairs.weigh(m, pairs.fit_idf(m), [*CONV, "pos"])), m)


B5 = f"""WITH {TFIDF}, p AS (SELECT a.conv_id, a.pos AS i, b.pos AS c, -0.8 * ln(1 + (a.pos - b.pos)::DOUBLE) + 1.2 * (lower(trim(a.role)) = lower(trim(b.role)))::INT
      + 1.5 * coalesce(n_shared::DOUBLE / greatest(1, least(len(list_distinct(a.ws)), len(list_distinct(b.ws)))), 0) + 2.0 * coalesce(cosine, 0)
      + 0.6 * (regexp_matches(b.text, '\\?\\s*$') AND len(a.ws) <= 8)::INT + 0.9 * (b.pos = a.pos - 1)::INT
      + 2.5 * (regexp_extract(a.text, '^([A-Za-z0-9_|{{}}\\[\\]^`-]+)\\s*[:,]', 1) <> '' AND lower(regexp_extract(a.text, '^([A-Za-z0-9_|{{}}\\[\\]^`-]+)\\s*[:,]', 1)) = lower(trim(b.role)))::INT AS score
    FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 100 LEFT JOIN cosn s ON s.conv_id = a.conv_id AND s.i = a.pos AND s.c = b.pos)"""


@query(
    "w08_b5_features",
    B5 + """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, c DESC) AS k, max(score) OVER (PARTITION BY conv_id, i) AS top FROM p),
  kept AS (SELECT * FROM r WHERE top >= 0.35 AND (k = 1 OR (k = 2 AND score > top - 0.05 AND score > 0.5)))
  SELECT 'turns' AS dataset, t.conv_id, t.pos AS child, coalesce(c, t.pos) AS parent FROM tok t LEFT JOIN kept b ON t.conv_id = b.conv_id AND t.pos = b.i""",
)
def w08(spark, sf):
    m = t.turns(spark, sf)
    return decode.one_or_two(pairs.feature_scores(m, pairs.fit_idf(m)), m)


@query(
    "u02_feature_scores",
    B5 + " SELECT 'turns' AS dataset, conv_id, i AS child, c AS parent, round(score, 6) AS score FROM p",
)
def u02(spark, sf):
    m = t.turns(spark, sf)
    return decode.edges_out(pairs.feature_scores(m, pairs.fit_idf(m)).withColumn("score", F.round("score", 6)), "score")


RANKED = MP + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, c) AS k, count(*) OVER (PARTITION BY conv_id, i) AS n FROM sc)"


@query("w09_threshold", RANKED + " SELECT dataset, conv_id, i AS child, c AS parent FROM r WHERE score >= 0.25 OR k = 1")
def w09(spark, sf):
    return decode.threshold(event_pairs(spark, sf), tau=0.25)


TAUS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]
GRID = RANKED + f""", tau AS (SELECT unnest({TAUS})::DOUBLE AS tau),
  m AS (SELECT tau, g.child IS NOT NULL AS hit FROM r CROSS JOIN tau LEFT JOIN gold g ON r.conv_id = g.conv_id AND r.i = g.child AND r.c = g.parent
    WHERE (k = 1 OR (k <= 3 AND score >= tau)) AND (r.conv_id, r.i) IN (SELECT (conv_id, child) FROM gold)),
  s AS (SELECT tau, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, (SELECT count(*) FROM gold WHERE child - parent <= 100) - count(*) FILTER (hit) AS fn FROM m GROUP BY 1),
  g AS (SELECT tau, tp, fp, fn, {t.prf_sql()} FROM s)"""


@query("w10_tau_grid", GRID + " SELECT * FROM g")
def w10(spark, sf):
    return decode.tau_grid(event_pairs(spark, sf), t.gold(spark, sf), TAUS)


@query("w10_best_tau", GRID + " SELECT tau, F1 FROM g ORDER BY F1 DESC, tau LIMIT 1")
def w10_best(spark, sf):
    return decode.best_tau(decode.tau_grid(event_pairs(spark, sf), t.gold(spark, sf), TAUS))


# a second score next to the first: how fresh the candidate's stretch of the window is
def two_scores(spark, sf):
    p = event_pairs(spark, sf)
    return p.select(
        *CONV, "_blk", "i", "c", F.col("score").alias("prob"),
        ((F.col("c") * 7 + F.col("i") * 3) % 11 / 10.0).alias("complete"), ((F.col("i") + F.col("c")) % 5 / 4.0).alias("context"),
    )


TWO = MP + """, d AS (SELECT dataset, conv_id, i, c, score AS prob, ((c * 7 + i * 3) % 11) / 10.0::DOUBLE AS complete, ((i + c) % 5) / 4.0::DOUBLE AS context FROM sc),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY prob DESC, c) AS k FROM d)"""


@query(
    "w11_easy_first",
    TWO + """, h AS (SELECT conv_id, i, arg_min(c, k) AS hit FROM r WHERE prob >= 0.02 AND complete >= 0.5 AND k <= 30 GROUP BY ALL)
  SELECT r.dataset, r.conv_id, r.i AS child, CASE WHEN prob < 0.1 THEN r.i ELSE coalesce(hit, c) END AS parent FROM r LEFT JOIN h USING (conv_id, i) WHERE k = 1""",
)
def w11(spark, sf):
    return decode.easy_first(two_scores(spark, sf), tau_root=0.1)


@query(
    "w12_oldest_first",
    TWO + """, a AS (SELECT *, min(CASE WHEN complete >= 0.95 THEN c END) OVER (PARTITION BY conv_id, i) AS stop FROM d WHERE prob >= 0.05)
  SELECT dataset, conv_id, i AS child, c AS parent FROM a WHERE stop IS NULL OR c <= stop QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY prob DESC, c) = 1""",
)
def w12(spark, sf):
    return decode.oldest_first(two_scores(spark, sf), tau_complete=0.95)


@query(
    "w13_fusion",
    TWO + """, f AS (SELECT *, 0.5 * ln(greatest(prob, 1e-9)) + context AS s FROM r WHERE k <= 10 AND prob >= 0.02),
  b AS (SELECT conv_id, i, c AS hit FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY round(s, 12) DESC, k) = 1)
  SELECT r.dataset, r.conv_id, r.i AS child, coalesce(hit, c) AS parent FROM r LEFT JOIN b USING (conv_id, i) WHERE k = 1""",
)
def w13(spark, sf):
    return decode.fused(two_scores(spark, sf), lam=0.5)


@query(
    "w14_rerank",
    TWO + """, top AS (SELECT * FROM r WHERE k = 1),
  duel AS (SELECT r.conv_id, r.i, r.c, r.k, (r.complete - t.complete) + (r.context - t.context) / 2 + r.prob / 4 AS swap FROM r JOIN top t USING (conv_id, i) WHERE r.k BETWEEN 2 AND 10 AND r.prob >= 0.02),
  b AS (SELECT conv_id, i, c AS won FROM duel WHERE swap > 0.5 QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY swap DESC, k) = 1)
  SELECT t.dataset, t.conv_id, t.i AS child, coalesce(won, c) AS parent FROM top t LEFT JOIN b USING (conv_id, i)""",
)
def w14(spark, sf):
    p = two_scores(spark, sf)
    duels = decode.challengers(p, ["prob", "complete", "context"])
    duels = duels.withColumn("swap", F.col("d_complete") + F.col("d_context") / 2 + F.col("prob") / 4)
    return decode.rerank(duels, decode.ranked(p, "prob").where("rank = 1"), "swap", 0.5)


@query(
    "w23_top_k_ranks",
    RANKED + " SELECT dataset, conv_id, i AS child, c AS parent, k AS rank, round(k::DOUBLE / n, 6) AS rank_share, round(score / max(score) OVER (PARTITION BY conv_id, i), 6) AS score_share FROM r QUALIFY k <= 10",
)
def w23(spark, sf):
    from pyspark.sql import Window

    r = decode.ranked(event_pairs(spark, sf))
    whole = Window.partitionBy(*pairs.PAIR)
    r = r.withColumns({"n": F.count("*").over(whole), "top": F.max("score").over(whole)}).where("rank <= 10")
    r = r.withColumns({"rank_share": F.round(F.col("rank") / F.col("n"), 6), "score_share": F.round(F.col("score") / F.col("top"), 6)})
    return decode.edges_out(r.withColumn("rank", F.col("rank").cast("long")), "rank", "rank_share", "score_share")


@query(
    "w24_negative_samples",
    MP + """, l AS (SELECT p.dataset, p.conv_id, p.i, p.c, (g.child IS NOT NULL)::INT AS label FROM pairs p LEFT JOIN gold g ON p.conv_id = g.conv_id AND p.i = g.child AND p.c = g.parent
    WHERE (p.conv_id, p.i) IN (SELECT (conv_id, child) FROM gold)),
  s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, i, label ORDER BY md5(concat_ws('|', dataset, conv_id, i, c, 7)), c) AS k FROM l)
  SELECT dataset, conv_id, i, c, label FROM s WHERE label = 1 OR k <= 2""",
)
def w24(spark, sf):
    gold = t.gold(spark, sf)
    labelled = pairs.label(pairs.candidates(t.messages(spark, sf), gold=gold), gold)
    return decode.sample_negatives(labelled).select(*CONV, "i", "c", "label")


@query(
    "w25_softmax_top1",
    f"""WITH {t.MSGS}, p AS (SELECT a.dataset, a.conv_id, a.pos AS i, b.pos AS c,
    CASE WHEN a.pos = b.pos THEN 0.5::DOUBLE ELSE (1 + 40 * (a.author = b.author)::INT::DOUBLE) / (20.0::DOUBLE * (a.pos - b.pos)) END AS score
    FROM msgs a JOIN msgs b ON a.conv_id = b.conv_id AND b.pos <= a.pos AND b.pos >= a.pos - 100 WHERE a.pos >= 100),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY conv_id, i)) AS e FROM p), q AS (SELECT *, e / sum(e) OVER (PARTITION BY conv_id, i) AS prob FROM e)
  SELECT dataset, conv_id, i AS child, c AS parent, round(prob, 6) AS prob FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, c) = 1""",
)
def w25(spark, sf):
    p = pairs.candidates(t.messages(spark, sf), ["author"], ["author"], include_self=True)
    near = (1 + 40 * (F.col("i_author") == F.col("c_author")).cast("double")) / (20.0 * F.greatest(F.col("i") - F.col("c"), F.lit(1)))
    p = p.withColumn("score", F.when(F.col("i") == F.col("c"), F.lit(0.5)).otherwise(near))
    return decode.softmax_top1(p, first=100).withColumn("prob", F.round("prob", 6))


@query(
    "k01_locate",
    f"""WITH {TFIDF}, q AS (SELECT item_id, w AS word, count(*) AS tf FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark) GROUP BY ALL),
  qw AS (SELECT item_id, q.word, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM tok)::DOUBLE) + 1) AS w FROM q LEFT JOIN idf USING (word)),
  qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
  s AS (SELECT item_id, t.conv_id, t.pos, sum(qw.w * t.w) / (any_value(qn.n) * any_value(nm.n)) AS sim FROM qw JOIN wt t USING (word)
    JOIN qn USING (item_id) JOIN nm ON nm.conv_id = t.conv_id AND nm.pos = t.pos JOIN tok k ON k.conv_id = t.conv_id AND k.pos = t.pos AND k.role <> 'system' GROUP BY ALL)
  SELECT item_id, 'turns' AS dataset, conv_id, pos, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, conv_id, pos) AS rank
  FROM s WHERE sim > 0.15 QUALIFY rank <= 10""",
)
def k01(spark, sf):
    from threadloom.operators.locate import locate

    texts = tune(spark).read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    got = locate(t.turns(spark, sf), texts, F.col("author") != "system")
    return got.withColumnRenamed("query_id", "item_id").withColumn("similarity", F.round("similarity", 6))

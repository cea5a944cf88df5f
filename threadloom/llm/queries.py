"""The numbered queries: driver tables -> operator -> contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.chat import chat_samples
from threadloom.llm.contamination import find_contamination
from threadloom.llm.language import identify_languages, language_model
from threadloom.llm.mixing import curriculum
from threadloom.llm.near import near_duplicates
from threadloom.llm.negatives import hard_negatives
from threadloom.llm.personal import BASE, find_personal_data
from threadloom.llm.quality import quality_rules
from threadloom.llm.substrings import drop_repeated_passages
from threadloom.llm.suffixes import drop_repeated_strings
from threadloom.llm.tokens import token_counts
from threadloom.llm.toxicity import score_toxicity, toxicity_model
from threadloom.llm.trie import prefix_trie
from threadloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def as_messages(docs: DataFrame) -> DataFrame:
    """documents -> messages: a document is one message of the stream (dataset) it came from."""
    return docs.select(F.col("doc_id").alias("msg_id"), F.col("source").alias("dataset"), "lang", "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return as_messages(tune(spark).read.parquet(f"{sf}/documents.parquet"))


@query("op2_repeated_passages")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    out = drop_repeated_passages(documents(spark, sf).select("msg_id", "text"))
    return out.select(F.col("msg_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    out = drop_repeated_strings(documents(spark, sf).select("msg_id", "text"))
    return out.select(F.col("msg_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))


def cyclic_schedules(messages: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over datasets by code point; every other dataset fades out, the rest fade in."""
    rank = F.row_number().over(Window.orderBy(F.col("dataset").asc_nulls_last())) - 1  # one row a dataset
    weight = (1 + rank % 3).cast("double")
    fade = F.when(rank % 2 == 0, F.array(1.5 * weight, 0.5 * weight)).otherwise(F.array(0.5 * weight, 1.5 * weight))
    return messages.select("dataset").distinct().select("dataset", fade.alias("weights"))


@query(
    "op3_mix_curriculum",
    """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '17', doc_id::VARCHAR)) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM src),
weighed AS (SELECT *, (1 + r % 3)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
plan AS (SELECT *, least(cap, w * (SELECT max(level) FROM levels)) AS target,
                CASE WHEN r % 2 = 0 THEN 1.5 * w ELSE 0.5 * w END AS w0,
                CASE WHEN r % 2 = 0 THEN 0.5 * w ELSE 1.5 * w END AS w1 FROM levels),
laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized),
copies AS (
  SELECT l.doc_id, l.size, l.before, p.*, l.before + e.e * p.source_size AS b,
         least(greatest(floor(p.target)::BIGINT - (l.before + e.e * p.source_size), 0), l.size)::BIGINT AS words, e.e AS e
  FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source, (SELECT unnest([0, 1, 2]) AS e) e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(words)::BIGINT AS taken,
       round(min(CASE WHEN words > 0 THEN
         2 * ((b + words / 2) / target * (w0 + w1) / 2)
           / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * ((b + words / 2) / target * (w0 + w1) / 2))) END), 9) AS position
FROM copies GROUP BY doc_id, size, before, source
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    msgs = documents(spark, sf).select("msg_id", "dataset", "text")
    out = curriculum(msgs, cyclic_schedules(msgs))
    return out.select(F.col("msg_id").alias("doc_id"), "size", F.col("dataset_size").alias("source_size"), "target", "taken", F.round("position", 9).alias("position"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf).select("msg_id", "text"), shingle=4)
    return out.withColumnRenamed("msg_id", "doc_id")


@query("op1_language")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    held = F.crc32(F.col("msg_id").cast("string").cast("binary")) % 3 == 1
    msgs = documents(spark, sf).select("msg_id", "text", "lang", held.alias("held_out"))
    model = language_model(msgs.where("not held_out"))
    out = identify_languages(msgs.select("msg_id", "text", "held_out"), model)
    return out.select(F.col("msg_id").alias("doc_id"), "held_out", "lang_pred", "score", F.size("lang_mix").alias("n_langs"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(documents(spark, sf).select("msg_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("msg_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    held = F.crc32(F.col("msg_id").cast("string").cast("binary")) % 4 == 2
    msgs = documents(spark, sf).select("msg_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("msg_id"), "toxic").where(~held)
    out = score_toxicity(msgs.withColumn("held_out", held), toxicity_model(msgs, labels))
    return out.select(F.col("msg_id").alias("doc_id"), "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


@query("op10_contamination")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = find_contamination(documents(spark, sf).select("msg_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return out.select(F.col("msg_id").alias("doc_id"), "contaminated", "n_items", items.alias("item_ids"), F.size("matches").cast("long").alias("n_matches"))


@query(
    "op6_quality",
    """
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * word_chars // greatest(n_words, 1) AS v1, 1000 * n_symbols // greatest(n_words, 1) AS v2,
         1000 * n_dup_lines // greatest(n_lines, 1) AS v3, 1000 * n_repeat_words // greatest(n_words, 1) AS v4
  FROM m),
cells AS (
  SELECT lang, source, k, v // (1::BIGINT << greatest(length(bin(v)) - 5, 0)::INT) * (1::BIGINT << greatest(length(bin(v)) - 5, 0)::INT) AS cell
  FROM (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS v FROM f WHERE NOT base_failed)),
grp AS (SELECT lang, source, count(*)::DOUBLE AS size FROM f WHERE NOT base_failed GROUP BY ALL),
sk AS (SELECT lang, source, k, cell, count(*) AS n FROM cells GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM sk),
q AS (
  SELECT lang, source, k, min(cell) FILTER (upto * 20 >= total * 5) AS q1, min(cell) FILTER (upto * 20 >= total * 15) AS q3,
         min(cell) FILTER (upto * 20 >= total * 18) AS q9
  FROM cum GROUP BY ALL),
own AS (
  SELECT q.lang, q.source, k, size, q1, q3, greatest(q3 - q1, q9 - q3) AS spread
  FROM q JOIN grp g ON q.lang IS NOT DISTINCT FROM g.lang AND q.source IS NOT DISTINCT FROM g.source),
mean AS (
  SELECT lang, k, floor(sum(size * q1) / sum(size)) AS m1, floor(sum(size * q3) / sum(size)) AS m3, floor(sum(size * spread) / sum(size)) AS ms
  FROM own GROUP BY ALL),
drawn AS (
  SELECT own.*, floor((size * q1 + 100 * m1) / (size + 100)) AS d1, floor((size * q3 + 100 * m3) / (size + 100)) AS d3,
         floor((size * spread + 100 * ms) / (size + 100)) AS ds
  FROM own JOIN mean ON own.lang IS NOT DISTINCT FROM mean.lang AND own.k = mean.k),
lim AS (
  SELECT lang, source, max(least(q1, d1) - 3 * ds) FILTER (k = 1) AS lo1, max(greatest(q3, d3) + 3 * ds) FILTER (k = 1) AS hi1,
         max(greatest(q3, d3) + 3 * ds) FILTER (k = 2) AS hi2, max(greatest(q3, d3) + 3 * ds) FILTER (k = 3) AS hi3,
         max(greatest(q3, d3) + 3 * ds) FILTER (k = 4) AS hi4
  FROM drawn GROUP BY ALL),
near AS (
  SELECT f.*, lo1, hi1, hi2, hi3, hi4, floor(3 * hi1 / sqrt(greatest(n_words, 1))) AS c1, 3000 // greatest(n_words, 1) AS c2,
         3000 // greatest(n_lines, 1) AS c3, 15000 // greatest(n_words, 1) AS c4
  FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND v1 BETWEEN lo1 - c1 AND hi1 + c1 AND v2 <= hi2 + c2 AND v3 <= hi3 + c3 AND v4 <= hi4 + c4, false) AS kept
FROM near
""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_rules(documents(spark, sf))
    return out.select(F.col("msg_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_chat_samples")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    turns = tune(spark).read.parquet(f"{sf}/conversations.parquet")
    msgs = turns.select(F.lit("turns").alias("dataset"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("pos"), F.col("role").alias("author"), "text")
    out = chat_samples(msgs)
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), "part", F.col("n_messages").alias("n_turns"), "n_quotes", "n_linked", "chat")


@query("op12_personal_data")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    out = find_personal_data(documents(spark, sf).select("msg_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = listed(of(*BASE))
    return out.select(F.col("msg_id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def turn_messages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations -> messages: a turn is a message of the dataset ``turns``, its role the author."""
    turns = tune(spark).read.parquet(f"{sf}/conversations.parquet")
    return turns.select(F.lit("turns").alias("dataset"), "conv_id", F.col("turn").alias("pos"), F.col("role").alias("author"), "text")


@query(
    "op13_prefix_trie",
    """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY k) AS l FROM t GROUP BY 1),
h AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: unicode(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1))))) % 9 AS h
  FROM own),
rb AS (
  SELECT h.conv_id, CASE WHEN b.l IS NULL THEN h.l[h + 1:] ELSE list_concat(b.l[1:h], h.l[h + 1:]) END AS l
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
mem AS (SELECT conv_id, d, l[1:d] AS p, d = len(l) AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rb)),
node AS MATERIALIZED (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS e,
         (count(*) - 1) * CASE WHEN d > 0 THEN strlen(p[d].x) ELSE 0 END AS w
  FROM mem GROUP BY d, p),
kid AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
tree AS MATERIALIZED (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid ON node.d = kid.d AND node.p = kid.p),
sub AS (
  SELECT a AS d, p[1:a] AS p, sum(w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM tree) GROUP BY ALL)
SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(t.e, '')) AS ends_sha256
FROM tree t JOIN sub s ON t.d = s.d AND t.p = s.p LEFT JOIN tree u ON u.d = t.d - 1 AND u.p = t.p[1:t.d - 1]
""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    msgs = turn_messages(spark, sf)
    n_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    heads = msgs.where("conv_id is not null").select("dataset", "conv_id").distinct().select("dataset", "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base_conv_id"), n_head.alias("n_head"))
    out = prefix_trie(msgs, heads)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query(
    "op11_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3
""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tune(spark).read.parquet(f"{sf}/embeddings.parquet")
    thread = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    msgs = vectors.select(F.col("vec_id").alias("msg_id"), thread.alias("thread"), F.col("embedding").alias("vector"))
    out = hard_negatives(msgs, F.col("msg_id") % 50 == 0)
    return out.withColumnsRenamed({f"{who}_msg_id": f"{who}_id" for who in ("anchor", "positive", "negative")})

"""Queries: line and answer parsing, prompts, scans and fingerprints over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import responses as rs
from threadloom.operators import normalize as nz
from threadloom.operators.chains import chain_edges
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.session import tune
from threadloom.sources import chatlogs, runs

M = f"WITH {t.MSGS}"


@query("a02_parse_lines", M + " SELECT dataset, conv_id, pos, CASE WHEN msg_id % 7 = 0 THEN '' ELSE author END AS speaker, CASE WHEN msg_id % 7 = 0 THEN '=== ' || author || ' joined' ELSE text END AS text, msg_id % 7 = 0 AS is_system FROM msgs")
def a02(spark, sf):
    # every seventh line is a system line
    m = t.messages(spark, sf)
    clock = F.concat(F.lit("["), F.date_format(F.timestamp_micros("ts_us"), "HH:mm"), F.lit("] "))
    body = F.when(F.col("msg_id") % 7 == 0, F.concat(F.lit("=== "), "author", F.lit(" joined"))).otherwise(F.concat(F.lit("<"), "author", F.lit("> "), "text"))
    lines = m.select(*CONV, "pos", chatlogs.parse_line(F.concat(clock, body)).alias("p"))
    return lines.select(*CONV, "pos", "p.*")


@query("a03_parse_annotations", f"WITH {t.MSGS}, {t.GOLD} SELECT dataset, conv_id, child, parent FROM gold UNION ALL SELECT dataset, conv_id, pos, pos FROM msgs WHERE (conv_id, pos) NOT IN (SELECT (conv_id, child) FROM gold)")
def a03(spark, sf):
    from threadloom.plans.reports import with_roots

    say = F.concat_ws(" ", F.col("parent").cast("string"), F.col("child").cast("string"), F.lit("-"))
    lines = with_roots(spark, sf).select(*CONV, F.explode(chatlogs.parse_annotation(say)).alias("e"))
    return lines.select(*CONV, "e.child", "e.parent")


@query("a05_gold_graph_lines", f"WITH {t.MSGS}, {t.GOLD} SELECT conv_id AS name, child, parent FROM gold")
def a05(spark, sf):
    say = F.concat(F.col("conv_id"), F.lit(":"), F.col("child").cast("string"), F.lit(" "), F.col("parent").cast("string"), F.lit(" -"))
    lines = t.gold(spark, sf).select(chatlogs.parse_gold_graph(say).alias("g"))
    return lines.select("g.*").distinct()


# an answer per conversation: its user and its other turns as two chains, the last turn by itself

@query(
    "a16_parse_chains",
    "WITH x AS (SELECT conv_id::VARCHAR AS conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), "
    "l AS (SELECT conv_id, pos AS child, lag(pos) OVER (PARTITION BY conv_id, role = 'user' ORDER BY pos) AS parent FROM x) "
    "SELECT 'turns' AS dataset, conv_id, child, parent FROM l WHERE parent IS NOT NULL UNION SELECT 'turns', conv_id, max(pos), max(pos) - 1 FROM x GROUP BY conv_id HAVING max(pos) > 0",
)
def a16(spark, sf):
    m = t.turns(spark, sf)
    ids = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("pos")))), lambda p: p.cast("string")), ",")
    user, last = F.col("author") == "user", F.max("pos")
    answer = F.concat(
        F.lit('Here: {"chains":[{"topic":"u","message_ids":['), ids(user), F.lit(']},{"topic":"o","message_ids":['), ids(~user),
        F.lit(']}],"backtrack":[{"message_id":'), last.cast("string"), F.lit(',"parent":'), (last - 1).cast("string"), F.lit("}]} done"),
    )
    parsed = m.groupBy(*CONV).agg(answer.alias("content")).select(*CONV, runs.parse_chains("content").alias("a"))
    members = parsed.select(*CONV, F.posexplode("a.chains").alias("chain", "c")).select(*CONV, "chain", F.explode("c.message_ids").alias("pos"))
    extra = parsed.select(*CONV, F.explode("a.backtrack").alias("b")).select(*CONV, F.col("b.message_id").alias("child"), "b.parent")
    return chain_edges(members, extra)


@query("a19_fingerprint")
def a19(spark, sf):
    return runs.fingerprint(t.messages(spark, sf))


@query(
    "f17_classify",
    "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'network' WHEN turn % 5 = 3 THEN 'bad_response' WHEN turn % 5 = 2 THEN 'output_truncated' WHEN turn % 5 = 1 THEN 'empty_content' END AS failure_mode, "
    "CASE WHEN turn % 5 IN (0, 2) THEN role END AS content FROM conversations",
)
def f17(spark, sf):
    k = F.col("turn") % 5
    raw = tune(spark).read.parquet(f"{sf}/conversations.parquet")
    say = lambda why, text: F.concat(F.lit(f'{{"choices":[{{"finish_reason":"{why}","message":{{"content":"'), text, F.lit('"}}]}'))
    body = F.when(k == 0, say("stop", F.col("role"))).when(k == 1, say("stop", F.lit(""))).when(k == 2, say("length", F.col("role"))).when(k == 3, F.lit('{"oops":1}'))
    got = raw.select("conv_id", "turn", rs.classify(body).alias("r"))
    return got.select("conv_id", "turn", "r.failure_mode", "r.content")


PROMPT = "string_agg('[' || pos || '] (' || role || ' @?) ' || substring(text, 1, 200), chr(10) ORDER BY pos)"


@query("f19_prompt_text", f"SELECT 'turns' AS dataset, conv_id::VARCHAR AS conv_id, 0::BIGINT AS \"window\", {PROMPT} AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) GROUP BY conv_id")
def f19(spark, sf):
    return rs.prompt_text(t.turns(spark, sf))


@query("f18_request_budget", "SELECT doc_id, least(8192, 400 + 80 * (n_chars % 200))::BIGINT AS max_tokens, length(text) // 2 AS est_tokens, length(text) // 2 > 60000 AS cut, CASE WHEN length(text) // 2 > 60000 THEN 120000 ELSE length(text) END::BIGINT AS sent_chars FROM documents")
def f18(spark, sf):
    docs = tune(spark).read.parquet(f"{sf}/documents.parquet")
    calls = docs.select("doc_id", F.col("text").alias("prompt"), rs.budget(F.col("n_chars") % 200).cast("long").alias("max_tokens"), F.lit(None).cast("string").alias("failure_mode"))
    got = rs.audit(calls)
    return got.select("doc_id", "max_tokens", "est_tokens", "cut", F.col("sent_chars").cast("long").alias("sent_chars"))


def scan_sql() -> str:
    parts = [f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT AS n FROM documents" for n, p in rs.SECRETS.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("f22_secret_scan", scan_sql())
def f22(spark, sf):
    return rs.scan(tune(spark).read.parquet(f"{sf}/documents.parquet"), "doc_id")


@query("a22_prediction_counts", f"WITH {t.MSGS}, {t.PREDS} SELECT dataset, algorithm, count(*) AS n FROM preds GROUP BY ALL")
def a22(spark, sf):
    from threadloom.session import table_path

    # written in two steps: half of the conversations first, then whatever is not there yet
    p = t.preds(spark, sf)
    path = table_path(spark, "preds")
    runs.write_table(p.where(F.crc32(F.col("conv_id").cast("binary")) % 2 == 0), path)
    done = spark.read.parquet(path)
    rest = nz.pending(p, done, ["dataset", "algorithm", "conv_id"])
    runs.write_table(rest, path)
    return spark.read.parquet(path).groupBy("dataset", "algorithm").agg(F.count("*").alias("n"))


@query("f10_node_features", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT 'turns' AS dataset, conv_id::VARCHAR AS conv_id, pos, round(ln(1 + len(string_split_regex(trim(text), '\\s+'))::DOUBLE), 6) AS log_words, round(pos::DOUBLE / greatest(n - 1, 1), 6) AS place,
    contains(text, '?')::INT::DOUBLE AS question, contains(text, '!')::INT::DOUBLE AS exclaim, starts_with(trim(text), '@')::INT::DOUBLE AS at_start FROM x""")
def f10(spark, sf):
    from threadloom.functions.lines import node_features

    got = node_features(t.turns(spark, sf), F.size(F.split(F.trim("text"), r"\s+")))
    return got.withColumns({c: F.round(c, 6) for c in ("log_words", "place")})


@query("f13_addressed_users", """WITH x AS (SELECT conv_id::VARCHAR AS conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role || '_' || (conv_id % 9) AS author FROM conversations),
  l AS (SELECT *, lag(author) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM x)
  SELECT 'turns' AS dataset, conv_id, pos, prev AS user FROM l WHERE prev IS NOT NULL""")
def f13(spark, sf):
    from threadloom.functions.lines import addressed_users

    # every turn is taken to address the author before it, in brackets and with a colon
    m = t.turns(spark, sf).withColumn("author", F.concat_ws("_", "author", (F.col("conv_id").cast("long") % 9).cast("string")))
    before = m.select(*CONV, (F.col("pos") + 1).alias("pos"), F.col("author").alias("prev"))
    said = m.join(before, [*CONV, "pos"], "left").withColumn("text", F.concat(F.lit("("), F.coalesce("prev", F.lit("-")), F.lit("): x")))
    return addressed_users(said)


@query("g11_thread_features", f"""WITH RECURSIVE {t.MSGS}, {t.GOLD},
  und AS (SELECT conv_id, child AS a, parent AS b, child AS at FROM gold UNION ALL SELECT conv_id, parent, child, child FROM gold),
  reach AS (SELECT conv_id, child AS i, parent AS c, parent AS x FROM gold
    UNION SELECT r.conv_id, r.i, r.c, u.b FROM reach r JOIN und u ON r.conv_id = u.conv_id AND r.x = u.a AND u.at < r.i),
  st AS (SELECT r.conv_id, r.i, r.c, count(*) AS size, min(r.x) AS first, count(*) FILTER (m.author = w.author) AS same
    FROM reach r JOIN msgs m ON m.conv_id = r.conv_id AND m.pos = r.x JOIN msgs w ON w.conv_id = r.conv_id AND w.pos = r.i GROUP BY ALL),
  gap AS (SELECT g.conv_id, g.child AS i, g.parent AS c, min(g.child - h.child) FILTER (h.child < g.child) AS near
    FROM gold g JOIN gold h ON g.conv_id = h.conv_id AND g.parent = h.parent GROUP BY ALL)
  SELECT g.dataset, st.conv_id, st.i, st.c, round(ln(1 + size), 6) AS log_size, round(same / size, 6) AS same_ratio, round(least(100, st.i - first) / 100, 6) AS span,
    (size > 1)::INT::DOUBLE AS max_prob, (size > 1)::INT::DOUBLE AS in_thread, round(ln(1 + coalesce(near, 100)), 6) AS reply_gap
  FROM st JOIN gap USING (conv_id, i, c) JOIN gold g ON g.conv_id = st.conv_id AND g.child = st.i AND g.parent = st.c""")
def g11(spark, sf):
    from threadloom.operators.merges import thread_features

    m, g = t.messages(spark, sf), t.gold(spark, sf)
    got = thread_features(m, g, g.select(*CONV, F.col("child").alias("i"), F.col("parent").alias("c")))
    return got.withColumns({c: F.round(c, 6) for c in ("log_size", "same_ratio", "span", "reply_gap")})


@query("g11_thread_cohesion", f"""WITH RECURSIVE {t.MSGS}, {t.GOLD},
  und AS (SELECT conv_id, child AS a, parent AS b, child AS at FROM gold UNION ALL SELECT conv_id, parent, child, child FROM gold),
  reach AS (SELECT conv_id, child AS i, parent AS c, parent AS x FROM gold
    UNION SELECT r.conv_id, r.i, r.c, u.b FROM reach r JOIN und u ON r.conv_id = u.conv_id AND r.x = u.a AND u.at < r.i),
  v AS (SELECT conv_id, pos, [1.0, (msg_id % 7)::DOUBLE - 3, (msg_id % 11)::DOUBLE - 5] AS v FROM msgs),
  s AS (SELECT r.conv_id, i, c, [sum(v[1]), sum(v[2]), sum(v[3])] AS s FROM reach r JOIN v ON v.conv_id = r.conv_id AND v.pos = r.x GROUP BY ALL)
  SELECT 'events' AS kind, s.conv_id, i, c, round(list_inner_product(s, v) / (sqrt(list_inner_product(s, s)) * sqrt(list_inner_product(v, v)) + 1e-9), 6) AS cohesion
  FROM s JOIN v ON v.conv_id = s.conv_id AND v.pos = s.i""")
def g11_cohesion(spark, sf):
    """Cosine of a message and the summed vectors of its parent's thread; vectors from the event number."""
    from threadloom.operators.merges import thread_features

    m, g = t.messages(spark, sf), t.gold(spark, sf)
    part = lambda k, off: F.col("msg_id") % k - off
    vectors = m.select(*CONV, "pos", F.array(F.lit(1), part(7, 3), part(11, 5)).cast("array<double>").alias("vec"))
    got = thread_features(m, g, g.select(*CONV, F.col("child").alias("i"), F.col("parent").alias("c")), vectors)
    return got.select(F.lit("events").alias("kind"), "conv_id", "i", "c", F.round("cohesion", 6).alias("cohesion"))

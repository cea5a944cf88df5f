"""Queries: every reader and sink over files in its format, written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.lines import message_vectors
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.session import table_path
from threadloom.sources import chatlogs, runs, threads

M = f"WITH {t.MSGS}"
G = f"WITH {t.MSGS}, {t.GOLD}"


def named_files(rows: DataFrame, folder: str, suffix: str) -> None:
    """Write ``value`` in order of ``pos`` to ``folder/part/name + suffix``, one file for each (part, name)."""
    spark, draft = rows.sparkSession, f"{folder}-draft{suffix}"
    laid = rows.select("part", "name", "pos", "value").repartition("part", "name").sortWithinPartitions("part", "name", "pos")
    laid.drop("pos").write.partitionBy("part", "name").text(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in spark.read.text(draft, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "part", "name").collect():  # one row a file
        files.mkdirs(path(f"{folder}/{f.part}"))
        files.rename(path(f.f), path(f"{folder}/{f.part}/{f.name}{suffix}"))


SPLIT = "CASE WHEN dataset < 'd' THEN 'dev' ELSE 'test' END"


def log_files(spark: SparkSession, sf: str) -> str:
    """The event messages as token, raw and annotation lines: two splits, a file a conversation."""
    folder = table_path(spark, "logs")
    msgs = t.messages(spark, sf).select(F.expr(SPLIT).alias("part"), F.col("conv_id").alias("name"), *CONV, "pos", "author", "text", "ts_us")
    clock = F.concat(F.lit("["), F.date_format(F.timestamp_micros("ts_us"), "HH:mm"), F.lit("] <"), "author", F.lit("> "), "text")
    named_files(msgs.withColumn("value", F.concat(F.lit("<s> "), "text", F.lit(" </s>"))), folder, ".tok.txt")
    named_files(msgs.withColumn("value", clock), folder, ".ascii.txt")
    links = msgs.join(t.gold(spark, sf).withColumnRenamed("child", "pos"), [*CONV, "pos"], "left").withColumn("parent", F.coalesce("parent", "pos"))
    named_files(links.withColumn("value", F.concat_ws(" ", "parent", "pos", F.lit("-"))), folder, ".annotation.txt")
    return folder


@query("a01_chat_logs", M + f" SELECT {SPLIT} AS dataset, conv_id, pos, author, text, false AS is_system, len(string_split(text, ' ')) + 1 AS n_tokens FROM msgs")
def a01(spark, sf):
    msgs, _ = chatlogs.read_chat_logs(spark, log_files(spark, sf), with_gold=False)
    return msgs.select(*CONV, "pos", "author", "text", "is_system", F.size("tokens").cast("long").alias("n_tokens"))


@query("a04_splits", G + f""" SELECT {SPLIT} AS dataset, conv_id, child, parent FROM (SELECT dataset, conv_id, child, parent FROM gold
  UNION ALL SELECT dataset, conv_id, pos, pos FROM msgs WHERE (conv_id, pos) NOT IN (SELECT (conv_id, child) FROM gold))""")
def a04(spark, sf):
    return chatlogs.read_chat_logs(spark, log_files(spark, sf))[1]


@query("a06_profile_logs", M + f""", s AS (SELECT {SPLIT} AS split, * FROM msgs), r AS (SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY conv_id) AS k FROM s)
  SELECT split AS dataset, conv_id, pos, (hour(make_timestamp(ts_us)) * 3600 + minute(make_timestamp(ts_us)) * 60)::INTEGER AS seconds FROM r WHERE k <= 4""")
def a06(spark, sf):
    msgs, edges = chatlogs.read_chat_logs(spark, log_files(spark, sf))
    return chatlogs.profile_logs(msgs, edges, 4)[0].select(*CONV, "pos", "seconds")


TURNS = "x AS (SELECT conv_id::VARCHAR AS conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"


@query("a07_discourse_json", f"WITH {TURNS} SELECT conv_id, pos AS child, pos - 1 AS parent, 'Q' || role AS type FROM x WHERE pos > 0")
def a07(spark, sf):
    """Fifty dialogues a file; each also has a self link and one out of range, which go."""
    m, folder = t.turns(spark, sf), table_path(spark, "edus")
    said = F.array_sort(F.collect_list(F.struct("pos", "text", "author")))  # the messages of one dialogue are one record of the format
    docs = m.groupBy("conv_id").agg(said.alias("m"))
    edus = F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["author"].alias("speaker")))
    link = lambda x, y, kind: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), kind.alias("type"))
    links = F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda x: link(x["pos"] - 1, x["pos"], F.concat(F.lit("Q"), x["author"])))
    links = F.concat(links, F.array(link(F.lit(0), F.lit(0), F.lit("S")), link(F.lit(0), F.size("m"), F.lit("S"))))
    doc = F.struct(F.col("conv_id").alias("id"), edus.alias("edus"), links.alias("relations"))
    files = docs.groupBy((F.col("conv_id").cast("long") / 50).cast("long").alias("name")).agg(F.to_json(F.collect_list(doc)).alias("value"))
    named_files(files.select(F.lit("all").alias("part"), "name", F.lit(0).alias("pos"), "value"), folder, ".json")
    return threads.read_edu_json(spark, f"{folder}/all/*.json")[1].select("conv_id", "child", "parent", "type")


def thread_lines(spark: SparkSession, sf: str) -> str:
    """A line a conversation with scalar parents (the first one), every other line followed by a broken one."""
    folder = table_path(spark, "threads")
    msgs, gold = t.messages(spark, sf), t.gold(spark, sf)
    up = gold.groupBy(*CONV, F.col("child").alias("pos")).agg(F.concat(F.lit("m"), F.min("parent")).alias("parent"))
    rows = msgs.join(up, [*CONV, "pos"], "left")
    one = F.struct("pos", F.concat(F.lit("m"), "pos").alias("id"), "author", F.coalesce("parent", F.lit("")).alias("parent"), (F.col("ts_us") / 1e6).alias("ts"), "text")
    lines = rows.groupBy(*CONV).agg(F.to_json(F.struct("dataset", "conv_id", F.array_sort(F.collect_list(one)).alias("msgs"))).alias("line"))
    lines.select(F.concat("line", F.lit("\n{broken")).alias("value")).write.text(folder)
    return folder


UP = "up AS (SELECT dataset, conv_id, child, min(parent) AS parent FROM gold GROUP BY ALL)"


@query("a08_thread_lines", G + f", {UP} SELECT * FROM up")
def a08(spark, sf):
    return threads.read_threads(spark, thread_lines(spark, sf))[1]


@query("a11_benchmark_threads", G + f""", {UP}, ok AS (SELECT conv_id FROM up GROUP BY 1 HAVING count(*) >= 10 ORDER BY conv_id LIMIT 8),
  sz AS (SELECT conv_id, greatest(count(*) - 150, 0) AS cut FROM msgs GROUP BY 1)
  SELECT dataset, conv_id, child - cut AS child, parent - cut AS parent FROM up JOIN ok USING (conv_id) JOIN sz USING (conv_id) WHERE parent >= cut""")
def a11(spark, sf):
    """The first eight conversations with ten parented messages, the last 150 messages of each."""
    return threads.read_threads(spark, thread_lines(spark, sf), min_parented_msgs=10, limit=8, max_msgs=150)[1]


@query("a09_channel_dump", """WITH k AS (SELECT event_type || '-wNone' AS conv_id, event_id::VARCHAR AS msg_id, user_id::VARCHAR AS author, epoch_us(ts) AS tt FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 3)
  SELECT conv_id, msg_id, author, row_number() OVER (PARTITION BY conv_id ORDER BY tt, msg_id) - 1 AS pos FROM k""")
def a09(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    folder = table_path(spark, "dump")
    kind = F.when(F.col("event_id") % 7 == 3, 6).when(F.col("event_id") % 7 == 4, 19).otherwise(0)
    ev.select(
        F.col("event_id").cast("string").alias("id"), kind.alias("type"), (F.col("event_id") % 11 == 0).alias("is_bot"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.col("event_type").alias("channel_id"),
        F.col("props").alias("content"), F.struct(F.col("user_id").cast("string").alias("id")).alias("author"),
    ).write.json(folder)
    return threads.read_channel_dump(spark, folder, by_week=False)[0].select("conv_id", "msg_id", "author", "pos")


@query("a10_chat_parquet", """WITH k AS (SELECT 'w/' || event_type || '/' || strftime(ts, '%Y-%m-%d') AS conv_id, user_id::VARCHAR AS author, props AS text, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS tt, user_id % 3 = 0 AS is_mention FROM events)
  SELECT conv_id, author, is_mention, row_number() OVER (PARTITION BY conv_id ORDER BY tt, author, md5(CASE WHEN is_mention THEN '<@x> ' ELSE '' END || text)) - 1 AS pos FROM k""")
def a10(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    folder = table_path(spark, "chat")
    text = F.concat(F.when(F.col("user_id") % 3 == 0, F.lit("<@x> ")).otherwise(F.lit("")), "props")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    ev.select(F.lit("w").alias("workspace"), F.col("event_type").alias("channel"), text.alias("text"), ts.alias("ts"), F.col("user_id").cast("string").alias("user"), "value").write.parquet(folder)
    return threads.read_chat_parquet(spark, folder).select("conv_id", "author", "is_mention", "pos")


@query("a12_reply_tree", f"WITH {TURNS} SELECT conv_id::BIGINT * 1000 + pos AS id, CASE WHEN pos > 0 THEN conv_id::BIGINT * 1000 + pos - 1 END AS parent, pos::INTEGER AS depth, length(role)::INTEGER AS tlen FROM x")
def a12(spark, sf):
    """Each turn is the only reply to the one before it."""
    m, folder = t.turns(spark, sf), table_path(spark, "trees")
    at = lambda k: (F.col("conv_id").cast("long") * 1000 + F.col("pos") + k).cast("string")
    head = F.concat(F.lit('{"id": '), at(0), F.when(F.col("pos") > 0, F.concat(F.lit(', "parent_id": '), at(-1))).otherwise(F.lit("")), F.lit(', "text": "'), "author", F.lit('", "children": ['))
    parts = F.array_sort(F.collect_list(F.struct("pos", head.alias("h"))))  # a tree is one record of the format
    trees = m.groupBy("conv_id").agg(parts.alias("p"))
    trees.select(F.concat(F.array_join("p.h", ""), F.repeat(F.lit("]}"), F.size("p"))).alias("value")).write.text(folder)
    return threads.flatten_tree(spark, folder).select("id", "parent", "depth", "tlen")


@query("a13_word_vectors", "SELECT DISTINCT 'u' || user_id AS word, user_id::DOUBLE AS first, (user_id % 7)::DOUBLE AS last FROM events WHERE user_id % 5 <> 0")
def a13(spark, sf):
    """A line a user; every fifth lacks a number and is skipped."""
    users, folder = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct(), table_path(spark, "vectors")
    nums = F.when(F.col("user_id") % 5 == 0, F.array("user_id")).otherwise(F.array(F.col("user_id"), F.lit(0).cast("long"), F.col("user_id") % 7))
    users.select(F.concat_ws(" ", F.concat(F.lit("U"), "user_id"), nums.cast("array<string>")).alias("value")).write.text(folder)
    got = runs.read_word_vectors(spark, folder, 3)
    return got.select("word", F.get("vec", F.lit(0)).cast("double").alias("first"), F.get("vec", F.lit(2)).cast("double").alias("last"))


@query("a14_run_files", """WITH r AS (SELECT event_type AS dataset, user_id % 3 AS seed, count(*)::DOUBLE AS n, max(event_id)::DOUBLE AS top FROM events GROUP BY ALL)
  SELECT dataset, 'prev1' AS algorithm, seed::INTEGER AS seed, unnest(['n', 'link.top']) AS key, unnest([n, top]) AS value FROM r""")
def a14(spark, sf):
    """A file a run, named by dataset, algorithm and seed, with numbers on two levels and a text that is left out."""
    ev, folder = spark.read.parquet(f"{sf}/events.parquet"), table_path(spark, "runs")
    per = ev.groupBy(F.col("event_type").alias("d"), (F.col("user_id") % 3).alias("s")).agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    body = F.to_json(F.struct(F.struct("n", F.struct("top").alias("link"), F.lit("x").alias("note")).alias("metrics")))
    named_files(per.select(F.lit("all").alias("part"), F.concat("d", F.lit("__prev1__s"), "s").alias("name"), F.lit(0).alias("pos"), body.alias("value")), folder, ".json")
    return runs.flatten_metrics(spark, f"{folder}/all/*.json")


@query("a17_sinks", f"WITH {t.MSGS}, {t.PREDS} SELECT fmt, dataset, algorithm, count(*) AS n, sum(child - parent)::BIGINT AS dist FROM preds, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt) GROUP BY ALL")
def a17(spark, sf):
    """Predictions through every sink, one dataset of the table written a second time."""
    p, out = t.preds(spark, sf), None
    for fmt in ("csv", "json", "parquet"):
        path = table_path(spark, "sink")
        runs.write_table(p, path, fmt)
        runs.write_table(p.where("dataset < 'd'"), path, fmt, mode="overwrite")
        back = spark.read.format(fmt).option("header", True).load(path)
        one = back.groupBy(F.lit(fmt).alias("fmt"), "dataset", "algorithm").agg(F.count("*").alias("n"), F.sum(F.col("child").cast("long") - F.col("parent").cast("long")).alias("dist"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a21_instances", f"WITH {TURNS} SELECT 'turns' AS dataset, conv_id, pos AS child, pos - 1 AS parent, role FROM x WHERE pos > 0 AND pos % 3 <> 0")
def a21(spark, sf):
    """A line a conversation; every third message is a root."""
    m, folder = t.turns(spark, sf), table_path(spark, "instances")
    item = F.struct(F.col("pos").alias("idx"), "text", F.lit(0.0).alias("ts"), F.create_map(F.lit("role"), "author").alias("meta"))
    gold = F.struct(F.col("pos").cast("string").alias("key"), F.when(F.col("pos") % 3 == 0, -1).otherwise(F.col("pos") - 1).alias("value"))
    docs = m.groupBy(F.col("dataset"), F.col("conv_id").alias("instance_id")).agg(F.collect_list(item).alias("items"), F.map_from_entries(F.collect_list(gold)).alias("gold_parent"))
    docs.write.json(folder)
    msgs, edges = threads.read_instances(spark, folder)
    return edges.join(msgs.select(*CONV, F.col("pos").alias("child"), F.col("meta")["role"].alias("role")), [*CONV, "child"])


@query("f11_message_vectors", f"""WITH {TURNS}, w AS (SELECT conv_id, pos, unnest(string_split(text, ' ')) AS word FROM x), n AS (SELECT conv_id, pos, word, count(*) AS n FROM w GROUP BY ALL),
  v AS (SELECT conv_id, pos, n, CASE WHEN length(word) % 2 = 0 THEN [length(word)::DOUBLE, 1.0] WHEN lower(word) <> word AND (length(lower(word)) % 2 = 0) THEN [0.0, 0.0] ELSE [0.5, -1.0] END AS v FROM n)
  SELECT 'turns' AS dataset, conv_id, pos, unnest([0, 1]) AS d, unnest([max(v[1]), max(v[2])]) AS top, unnest([round(sum(n * v[1]) / sum(n), 6), round(sum(n * v[2]) / sum(n), 6)]) AS mean FROM v GROUP BY conv_id, pos""")
def f11(spark, sf):
    """Words of even length have a vector, all others take the one for unknown words."""
    m = t.turns(spark, sf).withColumn("tokens", F.split("text", " "))
    words = m.select(F.explode("tokens").alias("word")).distinct().where(F.char_length("word") % 2 == 0)
    vectors = words.select("word", F.array(F.char_length("word"), F.lit(1)).cast("array<float>").alias("vec"))
    unknown = spark.createDataFrame([("<unka>", [0.5, -1.0])], vectors.schema)
    got = message_vectors(m, vectors.unionByName(unknown), 2)
    return got.select(*CONV, "pos", "d", F.col("top").cast("double").alias("top"), F.round("mean", 6).alias("mean"))

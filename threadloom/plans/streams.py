"""Queries: streams over the given tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.text import mentions
from threadloom.plans import tables as t
from threadloom.plans.registry import query
from threadloom.schema import CONV
from threadloom.session import table_path, tune
from threadloom.streaming import online
from threadloom.streaming.ledger import Ledger


@query("t03_weekly_counts", "SELECT event_type, epoch_us(ts) // 604800000000 AS week, count(*) AS n_msgs, count(json_extract(props, '$.k')) AS n_mentions FROM events GROUP BY ALL")
def t03(spark, sf):
    return online.run_to_table(online.weekly_counts(online.read_event_stream(tune(spark), sf)), "complete")


@query("t01_stream_mentions", f"""WITH {t.MSGS}, {t.lookup_sql('look', 6, False, 0)}
  SELECT l.dataset, l.conv_id, l.name, c.msg_id AS child, p.msg_id AS parent, l.lag_us FROM look l JOIN msgs c ON c.conv_id = l.conv_id AND c.pos = l.child
  JOIN msgs p ON p.conv_id = l.conv_id AND p.pos = l.parent""")
def t01(spark, sf):
    """The batch result: a last row, two hours later and in no conversation, lets the watermark pass every event."""
    msgs = t.messages(spark, sf)
    folder = table_path(spark, "mention-source")
    src = msgs.select(*CONV, "msg_id", "author", F.timestamp_micros("ts_us").alias("ts"), mentions("text").alias("mentions"))
    flush = src.groupBy().agg(F.max("ts").alias("ts")).where("ts is not null")
    none = F.lit(None).cast("string")
    flush = flush.select(F.lit("").alias("dataset"), F.lit("").alias("conv_id"), F.lit(-1).cast("long").alias("msg_id"), none.alias("author"), (F.col("ts") + F.expr("interval 2 hours")).alias("ts"), F.array().cast("array<string>").alias("mentions"))
    src.unionByName(flush).write.parquet(folder)
    stream = spark.readStream.schema(src.schema).parquet(folder)
    return online.run_to_table(online.mention_edges(online.mention_rows(stream)))


def edge_batches(spark, sf, files: int):
    """The gold edges as a stream of ``files`` micro-batches that do not follow the order of messages."""
    edges = t.gold(spark, sf)
    folder = table_path(spark, "edge-source")
    edges.repartition(files, F.xxhash64(*CONV, "child", "parent")).write.parquet(folder)
    return spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("t02_stream_components", f"""WITH RECURSIVE {t.MSGS}, {t.GOLD},
  und AS (SELECT conv_id, child AS a, parent AS b, child, parent FROM gold UNION ALL SELECT conv_id, parent, child, child, parent FROM gold),
  reach AS (SELECT conv_id, child, parent, child AS x FROM gold
    UNION SELECT r.conv_id, r.child, r.parent, u.b FROM reach r JOIN und u ON r.conv_id = u.conv_id AND r.x = u.a AND (u.child, u.parent) <= (r.child, r.parent))
  SELECT g.dataset, r.conv_id, r.child, r.parent, min(x) AS comp FROM reach r JOIN gold g USING (conv_id, child, parent) GROUP BY ALL""")
def t02(spark, sf):
    """All edges in one batch, so each is taken in its place in the conversation."""
    edges = t.gold(spark, sf)
    folder = table_path(spark, "edge-source")
    edges.write.parquet(folder)
    stream = spark.readStream.schema(edges.schema).parquet(folder)
    return online.run_to_table(online.online_components(stream)).drop("lost")


@query("t02_final_components", f"""WITH RECURSIVE {t.MSGS}, {t.GOLD},
  und AS (SELECT dataset, conv_id, child AS a, parent AS b FROM gold UNION SELECT dataset, conv_id, parent, child FROM gold),
  reach AS (SELECT DISTINCT dataset, conv_id, a AS pos, a AS x FROM und UNION SELECT r.dataset, r.conv_id, r.pos, u.b FROM reach r JOIN und u ON r.conv_id = u.conv_id AND r.x = u.a)
  SELECT dataset, conv_id, pos, min(x) AS comp FROM reach GROUP BY ALL""")
def t02_final(spark, sf):
    """Four batches in mixed order; the end state does not depend on it."""
    return online.final_components(online.run_to_table(online.online_components(edge_batches(spark, sf, 4))))


RESUMED = """SELECT 'events' AS kind, event_id AS msg_id, event_type AS dataset, CAST(json_extract(props, '$.k') AS VARCHAR) AS name FROM events"""


@query("t05_resume", RESUMED)
def t05(spark, sf):
    """A stream cut off twice, before and after a batch's commit, and taken up again: the rows of the batch, once."""
    events = spark.read.schema(online.EVENTS).parquet(f"{sf}/events.parquet")
    folder = table_path(spark, "event-source")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(online.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = stream.select(F.lit("events").alias("kind"), F.col("event_id").alias("msg_id"), F.col("event_type").alias("dataset"), F.get_json_object("props", "$.k").alias("name"))
    sink = Ledger(spark, table_path(spark, "ledger"), "t05", ["msg_id"])
    for stop in (("written", 1), ("committed", 2)):
        sink.run(rows, stop=stop)
    sink.run(rows)
    return sink.read(rows.schema)


@query("t05_merged", """SELECT event_type AS dataset, count(*) AS n, max(event_id) AS last_msg FROM events GROUP BY ALL""")
def t05_merged(spark, sf):
    """Running counts written per batch and merged by key: the last batch of a key is its row."""
    events = spark.read.schema(online.EVENTS).parquet(f"{sf}/events.parquet")
    folder = table_path(spark, "event-source")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(online.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = stream.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_msg"))
    sink = Ledger(spark, table_path(spark, "ledger"), "t05_merged", ["dataset"])
    sink.run(counts, mode="update", stop=("written", 1))
    sink.run(counts, mode="update")
    return sink.read(counts.schema)

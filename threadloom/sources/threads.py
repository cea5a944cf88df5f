"""Threads and channel dumps in JSON and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.normalize import min_parented, min_size, truncate
from threadloom.operators.ordered import number_rows
from threadloom.schema import CONV, WEEK_US
from threadloom.session import materialize, tune

THREAD = "dataset string, conv_id string, title string, msgs array<struct<id:string,author:string,parent:string,parents:array<string>,ts:double,text:string,tlen:int>>, _corrupt_record string"
EDU = "id string, edus array<struct<text:string,speaker:string>>, relations array<struct<x:long,y:long,type:string>>"
DUMP = (
    "id string, type int, is_bot boolean, timestamp string, channel_id string, channel_name string, content string, "
    "author struct<id:string>, message_reference struct<message_id:string>, _corrupt_record string"
)
INSTANCE = "dataset string, instance_id string, items array<struct<idx:long,text:string,ts:double,meta:map<string,string>>>, gold_parent map<string,long>"
TREE = "id long, author string, parent_id long, story_id long, created_at_i long, text string"


def _positions(rows: DataFrame) -> DataFrame:
    """Number by time (missing first), then by the order in the source."""
    return number_rows(rows.withColumn("_t", F.coalesce("ts_us", F.lit(0).cast("long"))), CONV, ["_t", "nth"]).drop("_t")


def links_to_edges(msgs: DataFrame) -> DataFrame:
    """``parent_ids`` -> position edges; ids outside the conversation are dropped."""
    asked = msgs.select(*CONV, F.col("pos").alias("child"), F.explode("parent_ids").alias("msg_id"))
    at = msgs.select(*CONV, "msg_id", F.col("pos").alias("parent"))
    return asked.join(at, [*CONV, "msg_id"]).select(*CONV, "child", "parent").distinct()


def read_threads(
    spark: SparkSession, paths: str | Sequence[str], min_parented_msgs: int = 0, limit: int | None = None, max_msgs: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Thread JSONL -> (messages, edges); bad lines are skipped, a scalar parent becomes a list."""
    raw = tune(spark).read.schema(THREAD).json(paths).where("_corrupt_record is null and conv_id is not null")
    rows = raw.select("dataset", "conv_id", F.posexplode("msgs").alias("nth", "m"))
    one = F.when((F.col("m.parent").isNotNull()) & (F.col("m.parent") != "") & (F.col("m.parent") != "0"), F.array("m.parent"))
    msgs = _positions(
        rows.select(
            *CONV, "nth", F.col("m.id").alias("msg_id"), F.col("m.author").alias("author"), (F.col("m.ts") * 1e6).cast("long").alias("ts_us"),
            F.coalesce("m.text", F.lit("")).alias("text"), F.coalesce("m.tlen", F.length("m.text"), F.lit(0)).alias("tlen"),
            F.coalesce("m.parents", one, F.array().cast("array<string>")).alias("parent_ids"),
        )
    )
    if min_parented_msgs:
        msgs = min_parented(msgs, msgs.where(F.size("parent_ids") > 0).withColumnRenamed("pos", "child"), min_parented_msgs)
    if limit is not None:
        msgs = msgs.join(msgs.select(*CONV).distinct().orderBy("conv_id").limit(limit), CONV, "left_semi")
    edges = links_to_edges(msgs)
    return truncate(msgs, edges, max_msgs) if max_msgs else (msgs, edges)


def read_edu_json(spark: SparkSession, path: str, drop_self: bool = True, min_parented_msgs: int = 0) -> tuple[DataFrame, DataFrame]:
    """Discourse JSON (x = parent, y = child) -> (messages, edges with ``type``)."""
    raw = tune(spark).read.schema(EDU).json(path, multiLine=True)
    base = raw.withColumn("dataset", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)).withColumn("conv_id", F.col("id"))
    rows = base.select(*CONV, F.size("edus").alias("n"), F.posexplode("edus").alias("pos", "e"))
    msgs = rows.select(*CONV, F.col("pos").cast("long").alias("pos"), F.col("e.speaker").alias("author"), F.coalesce("e.text", F.lit("")).alias("text"))
    rel = base.select(*CONV, F.size("edus").alias("n"), F.explode("relations").alias("r"))
    ok = (F.col("r.x") >= 0) & (F.col("r.x") < F.col("n")) & (F.col("r.y") >= 0) & (F.col("r.y") < F.col("n"))
    edges = rel.where(ok & (F.col("r.x") != F.col("r.y")) if drop_self else ok)
    edges = edges.select(*CONV, F.col("r.y").alias("child"), F.col("r.x").alias("parent"), F.col("r.type").alias("type"))
    return (min_parented(msgs, edges, min_parented_msgs) if min_parented_msgs else msgs), edges


def read_channel_dump(spark: SparkSession, glob: str, min_msgs: int = 25, by_week: bool = True, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Channel NDJSON: no bots, message types 0, 19 and 21; (file, channel, week) or (channel) conversations.

    Texts are whole unless ``max_chars`` cuts them.
    """
    raw = tune(spark).read.schema(DUMP).json(glob)
    kept = raw.where("_corrupt_record is null and not coalesce(is_bot, false) and type in (0, 19, 21)")
    ts = F.unix_micros(F.try_to_timestamp("timestamp"))
    file = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    week = F.coalesce(F.floor(ts / WEEK_US), F.lit(0)).cast("string")
    conv = F.concat_ws("-", file, "channel_id", week) if by_week else F.concat_ws("-", "channel_id", F.lit("wNone"))
    ref = F.col("message_reference.message_id")
    text = F.coalesce("content", F.lit(""))
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    rows = kept.select(
        F.lit("channel").alias("dataset"), conv.alias("conv_id"), F.col("id").alias("msg_id"), F.col("author.id").alias("author"), ts.alias("ts_us"),
        text.alias("text"), F.col("id").alias("nth"),
        F.when(ref.isNotNull(), F.array(ref)).otherwise(F.array().cast("array<string>")).alias("parent_ids"),
    )
    msgs = _positions(min_size(rows, min_msgs))
    return msgs, links_to_edges(msgs)


def read_chat_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Workspace chat: only the five columns used are read; conversation = workspace/channel/day."""
    raw = tune(spark).read.parquet(path).select("workspace", "channel", "text", "ts", "user").where("ts is not null")
    day = F.substring("ts", 1, 10)
    rows = raw.select(
        F.lit("chat").alias("dataset"), F.concat_ws("/", "workspace", "channel", day).alias("conv_id"), F.col("user").alias("author"),
        F.unix_micros(F.try_to_timestamp("ts")).alias("ts_us"), F.coalesce("text", F.lit("")).alias("text"),
        F.contains("text", F.lit("<@")).alias("is_mention"), F.col("ts").alias("nth"), F.md5("text").alias("_tie"),
    )
    return number_rows(rows, CONV, ["nth", "author", "_tie"]).drop("_tie")


def flatten_tree(spark: SparkSession, path: str) -> DataFrame:
    """Nested reply trees (``children``) -> rows with depth, level by level over a VARIANT.

    Trees may have any depth; each level is written and the next one starts from there.
    """
    level = tune(spark).read.text(path).select(F.try_parse_json("value").alias("v"), F.lit(0).alias("depth")).where("v is not null")
    out = None
    while True:
        get = lambda f, ty: F.try_variant_get("v", f"$.{f}", ty)
        flat = level.select(
            get("id", "long").alias("id"), get("author", "string").alias("author"), get("parent_id", "long").alias("parent"),
            get("created_at_i", "long").alias("ts"), F.coalesce(F.length(get("text", "string")), F.lit(0)).alias("tlen"), "depth",
        )
        out = flat if out is None else out.unionByName(flat)
        level = level.select(F.explode(get("children", "array<variant>")).alias("v"), (F.col("depth") + 1).alias("depth"))
        level = materialize(level.select(F.to_json("v").alias("j"), "depth"), "level")
        if level.isEmpty():
            return out
        level = level.select(F.parse_json("j").alias("v"), "depth")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chain instances -> (messages with ``meta``, single-parent edges); root = no row."""
    raw = tune(spark).read.schema(INSTANCE).json(path).withColumnRenamed("instance_id", "conv_id")
    msgs = raw.select(*CONV, F.explode("items").alias("m")).select(*CONV, F.col("m.idx").alias("pos"), "m.text", "m.ts", "m.meta")
    gold = raw.select(*CONV, F.explode("gold_parent").alias("k", "parent")).where("parent <> -1")
    return msgs, gold.select(*CONV, F.col("k").cast("long").alias("child"), "parent")

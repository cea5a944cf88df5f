"""Messages from plain tables: who wrote when, in which channel, mentioning whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import mentions
from threadloom.operators.ordered import number_rows
from threadloom.schema import CONV, WEEK_US
from threadloom.session import materialize, tune

_PREPARED: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> int:
    """Hash of the names, sizes and times of the files below ``folder``, as the store lists them."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found, files = [], path.getFileSystem(conf).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def prepared(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a base table once per application and keep it as a written table.

    ``key`` is (name, folder).  The files of the folder, their sizes and times belong to the key, so
    new files give a new table.
    """
    full = (spark.sparkContext.applicationId, *key, _state(spark, key[1]))
    if full not in _PREPARED:
        _PREPARED[full] = materialize(build(), "-".join(str(k) for k in key[:1]))
    return _PREPARED[full]


def micros(col: str | Column) -> Column:
    """Epoch microseconds of a timestamp read in UTC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> messages without positions; channel = event type, mention = ``props.k``.

    The text carries two mentions: the user in ``props.k`` and the user ``floor(value)``.
    """
    tune(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = micros("ts")
    k = F.get_json_object("props", "$.k")
    v = F.floor("value").cast("string")
    return ev.select(
        F.col("event_type").alias("dataset"),
        F.concat_ws("-w", "event_type", F.floor(ts / WEEK_US).cast("string")).alias("conv_id"),
        F.col("event_id").alias("msg_id"),
        F.col("user_id").cast("string").alias("author"),
        ts.alias("ts_us"),
        F.concat(F.lit("<@"), k, F.lit("> "), F.col("event_type"), F.lit(" <@"), v, F.lit(">")).alias("text"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position-numbered messages of ``events``; conversation = channel x epoch week."""
    return prepared(
        spark, ("messages", sf_dir), lambda: number_rows(read_events(spark, sf_dir), CONV, ["ts_us", "msg_id"])
    )


def with_mentions(msgs: DataFrame, first_only: bool = False) -> DataFrame:
    """Add ``mentions``: distinct mentioned names of the text, or only the first one."""
    found = mentions("text")
    return msgs.withColumn("mentions", F.slice(found, 1, 1) if first_only else F.array_distinct(found))


def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> messages; author = role, position = rank of the turn, no time stamps."""
    tune(spark)
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    msgs = raw.select(
        F.lit("turns").alias("dataset"),
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").alias("msg_id"),
        F.col("role").alias("author"),
        F.lit(None).cast("long").alias("ts_us"),
        "text",
    )
    return number_rows(msgs, CONV, ["msg_id"])

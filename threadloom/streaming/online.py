"""Online counterparts: mention labels, components and weekly counts over streams.

State is kept per key and bounded by the watermark or the conversation; sinks write one folder per
micro-batch, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators.graph import chase
from threadloom.schema import CONV, HOUR_US
from threadloom.session import table_path

#: States of one conversation in :func:`mention_edges`; a state holds what waits for all of its names.
NAME_BUCKETS = 64

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None, late: list[int] | None = None, idle: bool = True) -> DataFrame:
    """Process what is available and return the written result.

    ``batch=N`` folders make the sink idempotent: a repeated batch overwrites itself.  With
    ``folder`` rows and progress stay there, and a later call goes on where this one ended.
    ``late`` receives the number of rows that came behind the watermark and were dropped.
    Without ``idle`` there are no batches without rows: state that expires by the clock asks for one
    after the other, so such a run would not end.
    """
    spark = stream.sparkSession
    folder = folder or table_path(spark, "stream")
    out, log = f"{folder}/rows", f"{folder}/log"

    def write(df: DataFrame, batch: int) -> None:
        target = f"{out}/batch=0" if mode == "complete" else f"{out}/batch={batch}"
        df.write.mode("overwrite").parquet(target)

    switch = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(switch)
    spark.conf.set(switch, str(idle).lower())
    try:  # a query keeps the setting it started with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        spark.conf.set(switch, before)
    query.awaitTermination()
    if late is not None:
        late.append(sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]))
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def read_event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", name)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def mention_rows(msgs: DataFrame, match: str = "exact") -> DataFrame:
    """One row per message under its author's name and one per mention under the mentioned name."""
    name = (lambda c: F.lower(c)) if match == "lower" else (lambda c: c)
    own = F.array(F.struct(name(F.col("author")).alias("name"), F.lit(1).alias("kind")))
    asked = F.transform(F.array_distinct("mentions"), lambda m: F.struct(name(m).alias("name"), F.lit(0).alias("kind")))
    rows = msgs.select(*CONV, "msg_id", "ts", F.explode(F.concat(own, asked)).alias("r"))
    return rows.select(*CONV, "r.name", "r.kind", "msg_id", "ts", F.unix_micros("ts").alias("ts_us"))


def mention_edges(rows: DataFrame, window_us: int = 6 * HOUR_US, delay: str = "1 hour") -> DataFrame:
    """Stream of (conversation, child, parent, lag_us): the latest earlier message of the mentioned name.

    Rows wait in the state until the watermark has passed them and are then taken in event-time
    order, mentions before messages of the same instant; later arrivals are dropped and counted by
    the engine.  Names of a conversation share ``NAME_BUCKETS`` states, as a state of its own costs a
    name far more than its rows do.  Between batches a state keeps its waiting rows and the last
    message of each name, until the watermark is more than ``window_us`` past that.
    """
    keys = [*CONV, "bucket"]
    schema = "dataset string, conv_id string, name string, child long, parent long, lag_us long"
    state = "name array<string>, ts array<long>, kind array<int>, msg array<long>, last_name array<string>, last_ts array<long>, last_msg array<long>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        name, ts, kind, msg, *held = st.get if st.exists else [()] * 7
        waiting = list(zip(ts, kind, msg, name))
        last = {n: (t, m) for n, t, m in zip(*held)}
        for pdf in batches:
            waiting += list(zip(pdf["ts_us"].tolist(), pdf["kind"].tolist(), pdf["msg_id"].tolist(), pdf["name"].tolist()))
        waiting.sort(key=lambda r: r[:3])
        mark = st.getCurrentWatermarkMs() * 1000
        found, n = [], 0
        for t, k, m, who in waiting:
            if t > mark:
                break
            n += 1
            if k == 1:
                last[who] = t, m
            elif who in last and last[who][0] >= 0 and last[who][0] < t and t - last[who][0] <= window_us:
                found.append((*key[:-1], who, m, last[who][1], t - last[who][0]))
        rest = waiting[n:]
        # nothing can refer any more to a name without rows whose last message is too old
        needed = {r[3] for r in rest}
        last = {who: at for who, at in last.items() if who in needed or mark - at[0] <= window_us}
        if not rest and not last:
            if st.exists:
                st.remove()
        else:
            st.update(([r[3] for r in rest], [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest], list(last), [t for t, _ in last.values()], [m for _, m in last.values()]))
            due = rest[0][0] if rest else max(t for t, _ in last.values()) + window_us
            st.setTimeoutTimestamp(max(due // 1000 + 1, st.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[*CONV, "name", "child", "parent", "lag_us"])

    timed = rows.withWatermark("ts", delay).withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(NAME_BUCKETS)))
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


class _Joined(StatefulProcessor):
    """Threads of one conversation: a map from a message to a smaller one of its thread; first messages have no entry.

    A batch reads and writes only the entries on the way from its own messages up, never the whole map.
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.smaller = handle.getMapState("smaller", "pos long", "smaller long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = {}
        fresh: set[int] = set()

        def look(x: int) -> int:
            if x not in known:
                known[x] = self.smaller.getValue((x,))[0] if self.smaller.containsKey((x,)) else x
            return known[x]

        def first(x: int) -> int:
            way = [x]
            while look(way[-1]) != way[-1]:
                way.append(known[way[-1]])
            for y in way[:-1]:
                if known[y] != way[-1]:
                    known[y] = way[-1]
                    fresh.add(y)
            return way[-1]

        batch = pd.concat(list(rows)).sort_values(["child", "parent"])
        out = []
        for child, parent in zip(batch["child"].tolist(), batch["parent"].tolist()):
            low, high = sorted((first(child), first(parent)))
            if low != high:
                known[high] = low
                fresh.add(high)
            out.append((*key, child, parent, low, high if low != high else None))
        for x in known if self.keep_ms else fresh:
            if known[x] != x:
                self.smaller.updateValue((x,), (known[x],))
        yield pd.DataFrame(out, columns=[*CONV, "child", "parent", "comp", "lost"]).astype({"lost": "Int64"})

    def close(self) -> None:
        pass


def online_components(edges: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Stream of (conversation, child, parent, comp, lost): the thread an edge leads to, and the one it ended.

    ``comp`` is the smallest position of the thread so far; ``lost`` is what the other thread was
    named until this edge (null if both ends were in one).  Edges of a batch are taken by child and
    parent; a thread loses its name at most once, so :func:`final_components` finds the end state from
    the rows alone, in whatever order batches came.

    State is one entry a message in a map (RocksDB), of which a batch touches what its edges lead to.
    With ``keep_ms`` entries untouched for that long expire, and such a thread starts anew (run it without
    idle batches).
    """
    spark = edges.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "dataset string, conv_id string, child long, parent long, comp long, lost long"
    mode = "processingTime" if keep_ms else "none"
    return edges.groupBy(*CONV).transformWithStateInPandas(_Joined(keep_ms), schema, "append", mode)


def final_components(rows: DataFrame) -> DataFrame:
    """(conversation, pos, comp) after all edges, from the rows of :func:`online_components`."""
    ends = chase(rows.where("lost is not null").select(*CONV, F.col("lost").alias("node"), F.col("comp").alias("up")), CONV)
    ends = ends.select(*CONV, F.col("node").alias("pos"), F.col("up").alias("comp"))
    seen = rows.select(*CONV, F.explode(F.array("child", "parent")).alias("pos")).distinct()
    return seen.join(ends, [*CONV, "pos"], "left").withColumn("comp", F.coalesce("comp", "pos"))


def weekly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages and mentions per channel and epoch week, as they come in."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    week = F.window("ts", "7 days")
    counts = timed.groupBy("event_type", week.alias("w")).agg(
        F.count("*").alias("n_msgs"), F.count(F.get_json_object("props", "$.k")).alias("n_mentions")
    )
    return counts.select("event_type", F.floor(F.unix_micros("w.start") / 604_800_000_000).alias("week"), "n_msgs", "n_mentions")

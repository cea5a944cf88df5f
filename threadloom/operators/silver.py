"""Silver reply edges from mentions: as-of joins by time and by position, and their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import MENTION_LOOSE, mentions
from threadloom.operators.ordered import last_before, quantiles
from threadloom.schema import CONV, HOUR_US
from threadloom.session import materialize


def sized(msgs: DataFrame, min_msgs: int) -> DataFrame:
    """Messages of conversations with at least ``min_msgs`` messages."""
    keep = msgs.groupBy(*CONV).count().where(F.col("count") >= min_msgs).select(*CONV)
    return msgs.join(keep, CONV, "left_semi")


def resolve_names(probes: DataFrame, names: DataFrame, match: str) -> DataFrame:
    """Attach the history key a mention looks at.

    ``exact`` and ``lower`` compare names directly.  ``fallback`` reads the exact name's history if
    that name occurs in the conversation at all, otherwise the history of the lower-cased name,
    which also holds the messages of all its spellings.
    """
    if match == "exact":
        return probes.withColumn("key", F.col("name"))
    if match == "lower":
        return probes.withColumn("key", F.lower("name"))
    known = names.select(*CONV, F.col("key").alias("name")).distinct().withColumn("_known", F.lit(True))
    return (
        probes.join(known, [*CONV, "name"], "left")
        .withColumn("key", F.when(F.col("_known"), F.col("name")).otherwise(F.lower("name")))
        .drop("_known")
    )


def mention_lookup(
    msgs: DataFrame, window_us: int = 6 * HOUR_US, match: str = "fallback", limit: int | None = None
) -> DataFrame:
    """One row per (message, distinct mentioned name) with the parent found for it, if any.

    ``msgs`` carries ``mentions``.  The parent is the latest message of that user strictly earlier
    in time, at most ``window_us`` before.  One ordered pass over (conversation, name): at equal
    times mentions sort before messages, so a message never answers a mention of its own instant.
    """
    base = msgs.select(*CONV, "pos", "ts_us", "author")
    if match == "lower":
        history = base.withColumn("key", F.lower("author"))
    elif match == "fallback":
        keys = F.array_distinct(F.array("author", F.lower("author")))
        history = base.withColumn("key", F.explode(keys))
    else:
        history = base.withColumn("key", F.col("author"))
    probes = msgs.select(*CONV, "pos", "ts_us", F.explode(F.array_distinct("mentions")).alias("name"))
    probes = resolve_names(probes, history, match)
    rows = probes.select(*CONV, "key", "ts_us", F.lit(0).alias("kind"), "pos", "name").unionByName(
        history.select(*CONV, "key", "ts_us", F.lit(1).alias("kind"), "pos", F.lit(None).cast("string").alias("name"))
    )
    seen = F.when(F.col("kind") == 1, F.struct(F.col("ts_us").alias("t"), F.col("pos").alias("p")))
    order = ["ts_us", "kind", "pos", "name"]
    found = last_before(rows, [*CONV, "key"], order, seen, "hit", limit).where("kind = 0")
    near = F.col("ts_us") - F.col("hit.t") <= window_us
    return found.select(
        *CONV,
        F.col("pos").alias("child"),
        "name",
        "ts_us",
        F.when(near, F.col("hit.p")).alias("parent"),
        F.when(near, F.col("ts_us") - F.col("hit.t")).alias("lag_us"),
    )


def edges_of(lookup: DataFrame) -> DataFrame:
    return lookup.where("parent is not null").select(*CONV, "child", "parent").distinct()


def positional_lookup(msgs: DataFrame, limit: int | None = None) -> DataFrame:
    """Every ``<@name>`` occurrence with the latest earlier position of exactly that author."""
    own = msgs.where("author <> ''").select(*CONV, F.col("author").alias("key"), "pos", F.lit(1).alias("kind"), F.lit(-1).alias("nth"))
    asked = msgs.select(*CONV, "pos", F.posexplode(mentions("text", MENTION_LOOSE)).alias("nth", "key"))
    rows = own.unionByName(asked.select(*CONV, "key", "pos", F.lit(0).alias("kind"), "nth"))
    hit = F.when(F.col("kind") == 1, F.col("pos"))
    found = last_before(rows, [*CONV, "key"], ["pos", "kind", "nth"], hit, "parent", limit)
    return found.where("kind = 0").select(*CONV, F.col("pos").alias("child"), F.col("key").alias("name"), "nth", "parent")


def silver_stats(msgs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Mention, resolution and multi-parent rates and lag quantiles in one row.

    The look-up is written once: three figures are taken from it.
    """
    lookup = materialize(lookup, "lookup")
    totals = msgs.agg(F.count("*").alias("n_msgs"))
    per_msg = lookup.groupBy(*CONV, "child").agg(
        F.count("*").alias("n_mentions"), F.count("parent").alias("n_found")
    )
    msg_part = per_msg.agg(
        F.count("*").alias("n_msgs_with_mention"),
        F.coalesce(F.sum("n_mentions"), F.lit(0)).alias("n_mentions"),
        F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_resolved"),
        F.count_if(F.col("n_found") > 1).alias("n_multi_parent"),
    )
    hits = lookup.where("parent is not null")
    sec, idx = F.col("lag_us") / 1e6, F.col("child") - F.col("parent")
    lag_part = quantiles(
        hits, [], {"lag_median_sec": (sec, 0.5), "lag_p90_sec": (sec, 0.9), "idx_lag_median": (idx, 0.5), "idx_lag_p90": (idx, 0.9)}
    )
    # three one-row tables side by side
    one = F.lit(1).alias("_one")
    out = totals.select("*", one).join(msg_part.select("*", one), "_one").join(lag_part.select("*", one), "_one").drop("_one")
    pct = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return out.select(
        "n_msgs",
        "n_msgs_with_mention",
        "n_mentions",
        "n_resolved",
        "n_multi_parent",
        pct("n_msgs_with_mention", "n_msgs").alias("mention_pct"),
        pct("n_resolved", "n_mentions").alias("resolution_pct"),
        pct("n_multi_parent", "n_msgs").alias("multi_parent_pct"),
        F.floor("lag_median_sec").alias("lag_median_sec"),
        F.floor("lag_p90_sec").alias("lag_p90_sec"),
        F.floor("idx_lag_median").alias("idx_lag_median"),
        F.floor("idx_lag_p90").alias("idx_lag_p90"),
    )


def validate(msgs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per dataset: conversations, messages, edges, and edges whose parent is later than the child."""
    at = msgs.select(*CONV, "pos", "ts_us")
    timed = (
        edges.join(at.select(*CONV, F.col("pos").alias("child"), F.col("ts_us").alias("t_child")), [*CONV, "child"])
        .join(at.select(*CONV, F.col("pos").alias("parent"), F.col("ts_us").alias("t_parent")), [*CONV, "parent"], "left")
        .groupBy("dataset")
        .agg(F.count("*").alias("n_edges"), F.count_if(F.col("t_parent") > F.col("t_child")).alias("n_violations"))
    )
    per_conv = msgs.groupBy(*CONV).agg(F.count("*").alias("n"))
    sizes = per_conv.groupBy("dataset").agg(F.count("*").alias("n_conv"), F.sum("n").alias("n_msgs"))
    return (
        sizes.join(timed, "dataset", "left")
        .na.fill(0, ["n_edges", "n_violations"])
        .withColumn("valid", (F.col("n_edges") > 0) & (F.col("n_violations") == 0))
    )


def gates(stats: DataFrame, checks: DataFrame, min_resolution: float = 90.0) -> DataFrame:
    """The three acceptance gates as flags next to the figures they are taken from."""
    worst = checks.agg(F.sum("n_violations").alias("n_violations"))
    one = F.lit(1).alias("_one")
    both = stats.select("resolution_pct", "multi_parent_pct", one).join(worst.select("n_violations", one), "_one").drop("_one")
    return both.select(
        "resolution_pct",
        "n_violations",
        "multi_parent_pct",
        (F.col("resolution_pct") >= min_resolution).alias("g1_resolution"),
        (F.col("n_violations") == 0).alias("g2_order"),
        F.col("multi_parent_pct").isNotNull().alias("g3_recorded"),
    )

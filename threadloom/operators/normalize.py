"""Filtering, re-indexing, truncation, splits: everything between a source and the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import md5_bucket
from threadloom.operators.ordered import number_rows, running_sum
from threadloom.schema import CONV, MAX_MSGS


def positions(rows: DataFrame, order: Sequence[str] = ("ts_us", "msg_id")) -> DataFrame:
    return number_rows(rows, CONV, list(order))


def id_edges(msgs: DataFrame, links: DataFrame) -> DataFrame:
    """(child_id, parent_id) links -> position edges; links to unknown ids are dropped."""
    at = msgs.select(*CONV, "msg_id", "pos")
    child = at.withColumnsRenamed({"msg_id": "child_id", "pos": "child"})
    parent = at.withColumnsRenamed({"msg_id": "parent_id", "pos": "parent"})
    found = links.join(child, [*CONV, "child_id"]).join(parent, [*CONV, "parent_id"])
    return found.select(*CONV, "child", "parent").distinct()


def self_links(edges: DataFrame) -> DataFrame:
    """Per child: replies (self links left out), and whether it is marked as a root."""
    return edges.groupBy(*CONV, F.col("child").alias("pos")).agg(
        F.count_if(F.col("child") != F.col("parent")).alias("n_replies"),
        F.max(F.col("child") == F.col("parent")).alias("is_root"),
    )


def drop_context(msgs: DataFrame, is_system: Column, context: int = 1000, min_msgs: int = 20) -> DataFrame:
    """Keep user messages after the context lines, in conversations that stay large enough."""
    kept = msgs.where(~is_system & (F.col("pos") >= context))
    return min_size(kept, min_msgs)


def min_size(msgs: DataFrame, min_msgs: int) -> DataFrame:
    keep = msgs.groupBy(*CONV).count().where(F.col("count") >= min_msgs).select(*CONV)
    return msgs.join(keep, CONV, "left_semi")


def min_parented(msgs: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Messages of conversations in which at least ``n`` messages have a parent."""
    keep = (
        edges.select(*CONV, "child").distinct().groupBy(*CONV).count().where(F.col("count") >= n).select(*CONV)
    )
    return msgs.join(keep, CONV, "left_semi")


def reindex(msgs: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renumber ``kept`` messages densely and carry the edges whose two ends were kept along."""
    out = number_rows(kept.withColumnRenamed("pos", "old_pos"), CONV, ["old_pos"])
    at = out.select(*CONV, "old_pos", "pos")
    moved = (
        edges.join(at.select(*CONV, F.col("old_pos").alias("child"), F.col("pos").alias("new_child")), [*CONV, "child"])
        .join(at.select(*CONV, F.col("old_pos").alias("parent"), F.col("pos").alias("new_parent")), [*CONV, "parent"])
        .select(*CONV, F.col("new_child").alias("child"), F.col("new_parent").alias("parent"))
    )
    return out, moved


def bright_region(msgs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only messages with a parent, renumbered; parents that are roots themselves are lost."""
    kids = edges.select(*CONV, F.col("child").alias("pos")).distinct()
    return reindex(msgs, edges, msgs.join(kids, [*CONV, "pos"], "left_semi"))


def truncate(msgs: DataFrame, edges: DataFrame, n: int = MAX_MSGS) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` messages of every conversation, renumbered, and the edges among them."""
    sizes = msgs.groupBy(*CONV).agg(F.count("*").alias("n_conv"))
    joined = msgs.join(sizes, CONV).withColumn("shift", F.greatest(F.col("n_conv") - n, F.lit(0)))
    # positions are dense, so cutting is a subtraction and needs no numbering
    kept = joined.where("pos >= shift").withColumn("pos", F.col("pos") - F.col("shift")).drop("n_conv", "shift")
    cut = edges.join(sizes, CONV).withColumn("shift", F.greatest(F.col("n_conv") - n, F.lit(0)))
    moved = cut.where("parent >= shift and child >= shift").select(
        *CONV, (F.col("child") - F.col("shift")).alias("child"), (F.col("parent") - F.col("shift")).alias("parent")
    )
    return kept, moved


def repair_parents(rows: DataFrame) -> DataFrame:
    """Null out ``parent_id`` where no message of the conversation has that id."""
    ids = rows.select(*CONV, F.col("msg_id").alias("parent_id"), F.lit(True).alias("_known"))
    out = rows.join(ids, [*CONV, "parent_id"], "left")
    return out.withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id"))).drop("_known")


def largest_until(msgs: DataFrame, budget: int = 80_000, min_msgs: int = 30) -> DataFrame:
    """Conversations by falling size until ``budget`` messages; the one that crosses it is kept."""
    sizes = msgs.groupBy(*CONV).agg(F.count("*").alias("n_msgs")).where(F.col("n_msgs") >= min_msgs)
    ranked = sizes.withColumn("_all", F.lit(0)).withColumn("_desc", -F.col("n_msgs"))
    summed = running_sum(ranked, ["_all"], ["_desc", *CONV], F.col("n_msgs"), "n_before")
    return summed.where(F.col("n_before") < budget).select(*CONV, "n_msgs", "n_before")


def first_conversations(msgs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` conversations by id (an explicit sort replaces file order)."""
    keep = msgs.select(*CONV).distinct().orderBy(*reversed(CONV)).limit(n)
    return msgs.join(keep, CONV, "left_semi")


def split_of(conv_id: str | Column, seed: int = 42, train: int = 70, dev: int = 15) -> Column:
    """train/dev/test by a seeded hash bucket of the conversation id, stable under new data."""
    col = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    bucket = md5_bucket(F.concat_ws("|", col, F.lit(str(seed))), 100)
    return F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test")


def fold_of(conv_id: str | Column, k: int = 5, seed: int = 42) -> Column:
    col = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return md5_bucket(F.concat_ws("|", col, F.lit(str(seed))), k)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys have not been written yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def top_per_group(rows: DataFrame, group: str, score: str, tiebreak: str, k: int, at_least: int) -> DataFrame:
    """Best ``k`` rows per group by score; Spark limits each group before the exchange."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc(score), tiebreak)
    return rows.where(F.col(score) >= at_least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parent_table(preds: DataFrame) -> DataFrame:
    """Predicted edges without self links as one row per child."""
    kept = preds.where("child <> parent")
    return kept.groupBy("algorithm", *CONV, "child").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("parent")), lambda p: p.cast("string")), ",").alias("parents")
    )

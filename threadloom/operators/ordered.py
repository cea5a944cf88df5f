"""Ordered per-group operators that stay correct and balanced when one group is huge.

A plain window sends a whole group to one task.  That is the best plan while every group fits, so
it is used whenever a cheap count says so.  Otherwise rows are range-partitioned on
(group, order): a big group then spans several tasks, each task works on its own stretch
(``_seg``), and a carry row per stretch continues the value of the stretch before.  At most one
group crosses each boundary, so there are never more carry rows than partitions and they can be
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize

#: Largest group that one task may hold in a plain window.
GROUP_ROWS = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group: one map-side-combined count."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fits(df: DataFrame, keys: Sequence[str], limit: int | None) -> bool:
    return largest_group(df, keys) <= (GROUP_ROWS if limit is None else limit)


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Write ``df`` range-partitioned on (keys, order) with the stretch number in ``_seg``."""
    cols = [*keys, *order]
    return materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_seg", F.spark_partition_id()),
        "layout",
    )


def _match(left: DataFrame, carry: DataFrame, keys: Sequence[str]) -> Column:
    cond = left["_seg"] == carry["_cseg"]
    for k in keys:
        cond = cond & left[k].eqNullSafe(carry[f"_c_{k}"])
    return cond


def _with_carry(laid: DataFrame, carry: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    carry = carry.select(
        F.col("_seg").alias("_cseg"), *[F.col(k).alias(f"_c_{k}") for k in keys], *cols
    )
    joined = laid.join(F.broadcast(carry), _match(laid, carry, keys), "left")
    return joined.drop("_cseg", *[f"_c_{k}" for k in keys])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    limit: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (the row itself excluded)."""
    out = _running(df, keys, order, value, name, limit, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    limit: int | None = None,
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the group; null if there is none."""
    return _running(df, keys, order, value, name, limit, F.max, F.greatest)


def _running(df, keys, order, value: Column, name: str, limit: int | None, of, both) -> DataFrame:
    before = Window.unboundedPreceding, -1
    if fits(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.withColumn(name, of(value).over(w))
    laid = lay_out(df.withColumn("_v", value), keys, order)
    per_seg = laid.groupBy("_seg", *keys).agg(of("_v").alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(*before)
    carry = per_seg.withColumn("_carry", of("_total").over(over)).where("_carry is not null")
    w = Window.partitionBy("_seg", *keys).orderBy(*order).rowsBetween(*before)
    local = laid.withColumn("_local", of("_v").over(w))
    out = _with_carry(local, carry, keys, ["_carry"])
    return out.withColumn(name, both(F.col("_local"), F.col("_carry"))).drop("_v", "_local", "_carry", "_seg")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", limit: int | None = None
) -> DataFrame:
    """0-based position inside the group; ``order`` must be a total order."""
    if fits(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, limit=0)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    limit: int | None = None,
) -> DataFrame:
    """Latest non-null ``value`` among the earlier rows of the group (as-of, carry forward)."""
    before = Window.unboundedPreceding, -1
    if fits(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    laid = lay_out(df.withColumn("_v", value), keys, order)
    key, at = F.struct(*keys), F.struct(*keys, *order)
    ends = laid.groupBy("_seg").agg(
        F.max(key).alias("_last"),
        F.max_by(F.struct(key.alias("k"), F.col("_v").alias("v")), F.when(F.col("_v").isNotNull(), at)).alias("_hit"),
        F.min(key).alias("_first"),
    )
    # what each stretch hands on for its last group (null if that group has no value there)
    handed = ends.select(
        "_seg",
        F.col("_last").alias("_k"),
        F.when(F.col("_hit.k") == F.col("_last"), F.col("_hit.v")).alias("_hv"),
        F.lit(0).alias("_need"),
    )
    wanted = ends.select("_seg", F.col("_first").alias("_k"), F.lit(None).cast(laid.schema["_v"].dataType).alias("_hv"), F.lit(1).alias("_need"))
    # one row per stretch and side, so this window sees at most two rows per partition
    w = Window.partitionBy("_k").orderBy("_seg", F.desc("_need")).rowsBetween(*before)
    carry = (
        handed.unionByName(wanted)
        .withColumn("_carry", F.last("_hv", ignorenulls=True).over(w))
        .where("_need = 1 and _carry is not null")
        .select("_seg", *[F.col(f"_k.{k}").alias(k) for k in keys], "_carry")
    )
    w = Window.partitionBy("_seg", *keys).orderBy(*order).rowsBetween(*before)
    local = laid.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    out = _with_carry(local, carry, keys, ["_carry"])
    return out.withColumn(name, F.coalesce("_local", "_carry")).drop("_v", "_local", "_carry", "_seg")


def quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[Column, float]], limit: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group: one row a group, one column for each name in ``wanted``.

    ``wanted`` maps a name to (value, share).  Equal values are counted first, on the map side as
    well, and running counts find the ranks, so no task holds the values of a large group.
    """
    values = list(dict.fromkeys(str(c) for c, _ in wanted.values()))
    first = {str(c): c for c, _ in wanted.values()}
    parts = F.array(*[F.struct(F.lit(k).alias("_w"), first[v].cast("double").alias("_x")) for k, v in enumerate(values)])
    counts = df.select(*by, F.inline(parts)).where("_x is not null").groupBy(*by, "_w", "_x").agg(F.count("*").alias("_n"))
    keys = [*by, "_w"]
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    rows = running_sum(counts, keys, ["_x"], F.col("_n"), "_b", limit).join(total, keys)
    cols = []
    for name, (value, share) in wanted.items():
        mine = F.col("_w") == values.index(str(value))
        rank = (F.col("_t") - 1) * share
        at = lambda k, mine=mine: F.max(F.when(mine & (F.col("_b") <= k) & (k < F.col("_b") + F.col("_n")), F.col("_x")))
        low, high = F.floor(rank), F.ceil(rank)
        part = F.max(F.when(mine, rank - low))
        cols.append((at(low) * (1 - part) + at(high) * part).alias(name))
    return rows.groupBy(*by).agg(*cols)

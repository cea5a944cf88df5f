"""Band operators: everything that looks back at most ``w`` positions.

Positions are cut into blocks.  A row also visits the next block when it is still in reach there,
so the shuffle key is (conversation, block): bounded work per key, no matter how long a
conversation is, and no pair is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.schema import CONV, WINDOW


#: Children in one partition of :func:`band_pairs`: a hundred times as many pairs are sorted or grouped there.
PART_ROWS = 10_000


def _block(pos: str | Column, size: int) -> Column:
    return F.floor(F.col(pos) / size) if isinstance(pos, str) else F.floor(pos / size)


def with_reach(df: DataFrame, pos: str, w: int, size: int) -> DataFrame:
    """Copy each row into its own block and, if a later row there can see it, into the next."""
    blk = _block(pos, size)
    visits = F.when((blk + 1) * size - F.col(pos) <= w, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn("_blk", F.explode(visits))


def band_pairs(
    children: DataFrame,
    candidates: DataFrame,
    w: int = WINDOW,
    include_self: bool = False,
    keys: Sequence[str] = tuple(CONV),
) -> DataFrame:
    """All (i, c) with c in [i-w, i); columns of the two sides keep their names.

    ``children`` carries position ``i`` and ``candidates`` position ``c``.  The output keeps
    ``_blk`` so that grouping by (keys, _blk, i) needs no further exchange.

    Both sides are dealt by block over as many partitions as the children need (one count): they
    are small, the pairs are not, so partitions must not be sized by what was shuffled, and a
    broadcast side would leave the pairs to be dealt later.
    """
    size, on = max(w, 128), [*keys, "_blk"]
    n = max(1, -(-children.count() // PART_ROWS))
    left = children.withColumn("_blk", _block("i", size)).repartition(n, *on)
    right = with_reach(candidates, "c", w, size).repartition(n, *on)
    joined = left.join(right.hint("shuffle_hash"), on)
    upper = F.col("c") <= F.col("i") if include_self else F.col("c") < F.col("i")
    return joined.where(upper & (F.col("c") >= F.col("i") - w))


def banded_last(
    rows: DataFrame,
    name: str,
    pos: str,
    is_source: Column,
    out: str,
    w: int = WINDOW,
    keys: Sequence[str] = tuple(CONV),
) -> DataFrame:
    """For every row: latest earlier source position with the same ``name`` at distance <= w."""
    size = 1024
    spread = with_reach(rows.withColumn("_src", F.when(is_source, F.col(pos))), pos, w, size)
    over = (
        Window.partitionBy(*keys, "_blk", name)
        .orderBy(pos)
        .rangeBetween(-w, -1)
    )
    found = spread.withColumn(out, F.max("_src").over(over))
    return found.where(F.col("_blk") == _block(pos, size)).drop("_blk", "_src")

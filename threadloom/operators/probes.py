"""Parent predictors.  A probe maps messages to preds(algorithm, dataset, conv_id, child, parent).

No row means "predicted root".  The first family (prev1, saprev, simmax) predicts inside the
window only; the second family (b1..b5) also emits self links for predicted roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import addressee, speaker
from threadloom.operators.blocks import banded_last
from threadloom.schema import CONV, WINDOW

PRED = ["algorithm", *CONV, "child", "parent"]
PROBES: dict[str, Callable[..., DataFrame]] = {}
STYLES: dict[str, str] = {}


def register_probe(name: str, style: str = "1to1"):
    """Register ``fn(msgs, **options) -> (dataset, conv_id, child, parent)`` under a name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(msgs: DataFrame, **options) -> DataFrame:
            return fn(msgs, **options).select(F.lit(name).alias("algorithm"), *CONV, "child", "parent")

        PROBES[name], STYLES[name] = run, style
        return run

    return add


def run_probes(msgs: DataFrame, names: list[str], **options) -> DataFrame:
    out = PROBES[names[0]](msgs, **options)
    for name in names[1:]:
        out = out.unionByName(PROBES[name](msgs, **options))
    return out


def _out(df: DataFrame, parent: Column) -> DataFrame:
    return df.select(*CONV, F.col("pos").alias("child"), parent.alias("parent"))


@register_probe("prev1")
def prev1(msgs: DataFrame) -> DataFrame:
    # positions are dense, so the previous message is arithmetic, not a window
    return _out(msgs.where("pos > 0"), F.col("pos") - 1)


@register_probe("saprev")
def saprev(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    rows = msgs.select(*CONV, "pos", "author")
    found = banded_last(rows, "author", "pos", F.col("author") != "", "_p", w)
    return _out(found.where("pos > 0"), F.coalesce("_p", F.col("pos") - 1))


@register_probe("b1_last")
def b1_last(msgs: DataFrame) -> DataFrame:
    return _out(msgs, F.greatest(F.col("pos") - 1, F.lit(0).cast("long")))


@register_probe("b2_speaker")
def b2_speaker(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    rows = msgs.select(*CONV, "pos", speaker("author").alias("name"))
    found = banded_last(rows, "name", "pos", F.col("name") != "", "_p", w)
    previous = F.greatest(F.col("pos") - 1, F.lit(0).cast("long"))
    unknown = F.coalesce(F.col("name"), F.lit("")) == ""
    return _out(found, F.when(unknown, previous).otherwise(F.coalesce("_p", "pos")))


def addressed_before(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """(dataset, conv_id, pos, asked, hit): the addressee and their latest message in the band."""
    own = msgs.select(*CONV, "pos", speaker("author").alias("name"), F.lit(True).alias("src"))
    asks = msgs.select(*CONV, "pos", addressee("text").alias("name")).where("name is not null")
    rows = own.unionByName(asks.withColumn("src", F.lit(False)))
    found = banded_last(rows, "name", "pos", F.col("src"), "hit", w).where("not src")
    return found.select(*CONV, "pos", F.col("name").alias("asked"), "hit")


@register_probe("b3_mention")
def b3_mention(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    got = msgs.select(*CONV, "pos").join(addressed_before(msgs, w), [*CONV, "pos"], "left")
    previous = F.greatest(F.col("pos") - 1, F.lit(0).cast("long"))
    return _out(got, F.when(F.col("asked").isNull(), previous).otherwise(F.coalesce("hit", "pos")))


def without_self(preds: DataFrame) -> DataFrame:
    """Self links are another way to write "root"."""
    return preds.where("child <> parent")

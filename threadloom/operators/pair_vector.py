"""The 77 features of a (message, candidate) pair in line logs, as one array per pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.blocks import band_pairs, with_reach
from threadloom.operators.ordered import last_before
from threadloom.operators.pairs import label, with_gold
from threadloom.schema import CONV, WINDOW
from threadloom.session import materialize

# Years that a log's name may show, and the edges of the bucket flags.
YEARS = range(2004, 2018)
RATE = (-1, 1, 3, 10, 10000)
DISTANCE = (-1, 0, 1, 5, 20, 1000)
SINCE = (-1, 0, 2, 10, 10000)
APART = (-1, 0, 1, 5, 60, 10000)


def _buckets(x: Column, edges: tuple) -> list[Column]:
    return [(x >= lo) & (x < hi) for lo, hi in zip(edges, edges[1:])]


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from time of day ``a`` to a later ``b``; a smaller hour means the next day; null: -1."""
    next_day = F.when(F.floor(b / 60) < F.floor(a / 60), 1440).otherwise(0)
    return F.coalesce(b - a + next_day, F.lit(-1))


def described(msgs: DataFrame) -> DataFrame:
    """Messages with what the pair features need of each side."""
    said = F.when(~F.col("is_system"), F.struct("pos", "minute", (F.size("targets") > 0).alias("addressed")))
    keys = [*CONV, "author"]
    rows = last_before(msgs, keys, ["pos"], said, "last")
    rows = last_before(rows.withColumn("_back", -F.col("pos")), keys, ["_back"], F.when(~F.col("is_system"), F.col("pos")), "next").drop("_back")
    at = msgs.select(*CONV, "pos", "author", "minute")
    shifted = lambda by, name: at.select(*CONV, (F.col("pos") + by).alias("pos"), F.col("author").alias(name))
    rows = rows.join(shifted(1, "before"), [*CONV, "pos"], "left").join(shifted(-1, "after"), [*CONV, "pos"], "left")
    timed = msgs.where("not is_system").groupBy(*CONV).agg(F.min("pos").alias("_first"), F.max("pos").alias("_lastp"))
    # the line before the last timed one ends the span, as in the published feature
    span = timed.join(at.select(*CONV, F.col("pos").alias("_first"), F.col("minute").alias("_m0")), [*CONV, "_first"], "left")
    span = span.withColumn("_end", F.col("_lastp") - 1).join(at.select(*CONV, F.col("pos").alias("_end"), F.col("minute").alias("_m1")), [*CONV, "_end"], "left")
    size = msgs.groupBy(*CONV).agg(F.count("*").alias("_n"))
    rate = F.col("_n") / F.greatest(minutes_between(F.col("_m0"), F.col("_m1")), F.lit(1))
    conv = size.join(span, CONV, "left").select(*CONV, "_n", rate.alias("rate"))
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return rows.join(conv, CONV).withColumn("words", words)


def _told(asked: DataFrame, near: DataFrame, ids: DataFrame, who: str, whom: str) -> DataFrame:
    """(conversation, i, [(c, lo, hi, in)]): the pairs where author ``who`` addresses author ``whom`` anywhere.

    lo, hi: first and last such message; in: whether one lies between the two.  Few pairs have any,
    so only their numbers travel, and the answers join the children before there are wide pairs.
    """
    reach = asked.groupBy(*CONV, F.col("who").alias(who), F.col("whom").alias(whom)).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    hits = materialize(ids.join(reach, [*CONV, who, whom]), "told")
    some = near.select(*CONV, "_blk", "n", F.col("who").alias(who), F.col("whom").alias(whom))
    some = hits.join(some, [*CONV, "_blk", who, whom]).where("c < n and n < i").select(*CONV, "_blk", "i", "c").distinct()
    rows = hits.join(some.withColumn("in", F.lit(True)), [*CONV, "_blk", "i", "c"], "left")
    return rows.groupBy(*CONV, "i").agg(F.collect_list(F.struct("c", "lo", "hi", "in")).alias(f"_{who}"))


def features77(msgs: DataFrame, w: int = WINDOW, gold: DataFrame | None = None) -> DataFrame:
    """(conversation, _blk, i, c, features ARRAY<DOUBLE> of 77) for every pair of the window, c = i included.

    msgs(dataset, conv_id, pos, author, minute, is_system, is_bot, targets, text): ``minute`` is the
    time of day of the message or of the last timed one before it, ``targets`` the lower-case names
    it addresses.  Order: year of the log (14), messages a minute (4), message (15), candidate (17),
    both (27).  With ``gold``, only pairs of children with gold parents, and those as ``_gold``.
    """
    pairs, flags = feature_columns(msgs, w, gold)
    kept = [] if gold is None else ["_gold"]
    return pairs.select(*CONV, "_blk", "i", "c", *kept, F.array(*flags).alias("features"))


def feature_means(msgs: DataFrame, gold: DataFrame, by: Sequence[str] = ("dataset", "label"), w: int = WINDOW) -> DataFrame:
    """(by, feature, n_pairs, mean) over the pairs of :func:`features77`; ``label``: whether the pair is a gold edge.

    Sums are taken where the pairs are made: one row a pair, not one a pair and feature.
    """
    pairs, flags = feature_columns(msgs, w, gold)
    sums = label(pairs, gold).groupBy(*by).agg(F.count("*").alias("n_pairs"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(flags)])
    rows = sums.select(*by, "n_pairs", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(len(flags))])).alias("feature", "_sum"))
    return rows.select(*by, "feature", "n_pairs", (F.col("_sum") / F.col("n_pairs")).alias("mean"))


def feature_columns(msgs: DataFrame, w: int = WINDOW, gold: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """The pairs of :func:`features77` and its 77 numbers as columns on them."""
    cols = ["author", "minute", "is_system", "is_bot", "targets", "last", "next", "before", "after", "rate", "words", "_n"]
    side = materialize(described(msgs), "sides")
    pick = lambda p, k: side.select(*CONV, F.col("pos").alias(k), *[F.col(c).alias(f"{p}{c}") for c in cols])
    asked = msgs.select(*CONV, F.col("pos").alias("n"), F.col("author").alias("who"), F.explode("targets").alias("whom"))
    near = with_reach(asked, "n", w, max(w, 128))
    kids = pick("q_", "i") if gold is None else with_gold(pick("q_", "i"), gold)
    kids = materialize(kids, "children")
    ids = band_pairs(kids.select(*CONV, "i", "q_author"), side.select(*CONV, F.col("pos").alias("c"), F.col("author").alias("l_author")), w)
    for who, whom in (("q_author", "l_author"), ("l_author", "q_author")):
        kids = kids.join(_told(asked, near, ids, who, whom), [*CONV, "i"], "left")
    pairs = band_pairs(materialize(kids, "children"), pick("l_", "c"), w, include_self=True)
    for name, who in (("ql", "q_author"), ("lq", "l_author")):
        pairs = pairs.withColumn(f"_{name}", F.get(F.filter(f"_{who}", lambda x: x["c"] == F.col("c")), F.lit(0)))
        pairs = pairs.withColumns({f"{name}_{x}": F.col(f"_{name}")[x] for x in ("lo", "hi", "in")})
    q, l, other = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"l_{c}")), F.col("i") != F.col("c")  # noqa: E731, E741
    dist, apart = F.col("i") - F.col("c"), minutes_between(F.col("l_minute"), F.col("q_minute"))

    def own(s, pos: str) -> list[Column]:
        last = s("last")
        gap = F.coalesce(F.col(pos) - last["pos"], F.lit(-1))
        since = minutes_between(last["minute"], s("minute"))
        return [F.size(s("targets")) > 0, last.isNotNull(), F.coalesce(last["addressed"], F.lit(False)), *_buckets(gap, DISTANCE), *_buckets(since, SINCE)]

    # asked for several times below
    pairs = pairs.withColumns({"_common": F.size(F.array_intersect(q("words"), l("words"))), "_apart": apart})
    common, apart = F.col("_common"), F.col("_apart")
    both = (F.size(q("words")) > 0) & (F.size(l("words")) > 0)
    shared = lambda s: F.when(other & both, common / F.size(s("words")))
    flags = [
        *[F.contains("conv_id", F.lit(str(y))) for y in YEARS],
        *_buckets(q("rate"), RATE),
        q("is_system"), F.floor(q("minute") / 60) / 24, *own(q, "i"), q("is_bot"),
        l("is_system"), F.floor(l("minute") / 60) / 24, *[other & x for x in own(l, "c")], l("is_bot"),
        other & (F.col("c") + 1 < l("_n")) & (l("author") == l("after")),
        other & (F.col("c") - 1 > 0) & (l("author") == l("before")),
        ~other, F.least(dist, F.lit(100)) / 100, dist > 1, F.least(apart, F.lit(100)) / 100, *_buckets(apart, APART),
        F.array_contains(l("targets"), F.lower(q("author"))), F.array_contains(q("targets"), F.lower(l("author"))),
        other & (q("last").isNull() | (q("last")["pos"] < F.col("c"))),
        other & (l("next").isNull() | (l("next") > F.col("i"))),
        *[other & x for n in ("ql", "lq") for x in (F.col(f"{n}_lo") < F.col("c"), F.col(f"{n}_hi") > F.col("i"), F.col(f"{n}_in"))],
        q("author") == l("author"), other & F.arrays_overlap(l("targets"), q("targets")),
        shared(l), shared(q), other & (common == 0), other & (common == 1), other & (common > 1), other & (common > 5),
    ]
    return pairs, [F.coalesce(x.cast("double"), F.lit(0.0)) for x in flags]

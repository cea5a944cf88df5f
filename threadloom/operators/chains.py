"""Reply chains: whole root-to-message chains, chains found by others, pruning, tracing, themes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import graph
from threadloom.operators.blocks import with_reach
from threadloom.operators.graph import by_size, hop_closure, keyed_schema
from threadloom.operators.ordered import last_before
from threadloom.schema import CONV
from threadloom.session import intermediates, materialize, release

#: Positions of a conversation that one task of :func:`_spread_reach` searches.
STRETCH = 4096
#: What a row (pos, to) says if ``to`` is no position: where the search begins, and where steps leave or enter a stretch.
SEED, EXIT, ENTRY = -1, -2, -3


def chains(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = tuple(CONV), limit: int | None = None) -> DataFrame:
    """(keys, pos, chain): positions from the root down to the message; one parent per message."""
    keys = list(keys)

    def local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            paths: dict[int, list[int]] = {}
            for child, parent in sorted(zip(pdf["child"].tolist(), pdf["parent"].tolist())):
                paths[child] = [*paths.get(parent, [parent]), child]
            return pd.DataFrame([(*key, c, p) for c, p in paths.items()], columns=[*keys, "pos", "chain"])

        found = edges.select(*keys, "child", "parent").groupBy(*keys).applyInPandas(walk, keyed_schema(edges, keys, "pos long, chain array<long>"))
        return _or_self(nodes, found, keys)

    def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        above = hop_closure(edges, keys).groupBy(*keys, F.col("node").alias("pos")).agg(F.array_sort(F.collect_list("anc")).alias("up"))
        # parents are earlier than children, so the chain is the sorted set of ancestors
        return _or_self(nodes, above.select(*keys, "pos", F.concat("up", F.array("pos")).alias("chain")), keys)

    return by_size(nodes, [edges], keys, graph.LOCAL_PAIRS if limit is None else limit, local, spread)


def _or_self(nodes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    out = nodes.select(*keys, "pos").join(found, [*keys, "pos"], "left")
    return out.withColumn("chain", F.coalesce("chain", F.array("pos")))


# ---------------------------------------------------------------- chains proposed from outside


def chain_edges(members: DataFrame, extra: DataFrame) -> DataFrame:
    """Link neighbours inside each proposed chain and add single proposals; only backward links stay.

    ``members(dataset, conv_id, chain, pos)``, ``extra(dataset, conv_id, child, parent)``.
    """
    key = [*CONV, "chain"]
    linked = last_before(members.select(*key, "pos").distinct(), key, ["pos"], F.col("pos"), "parent").where("parent is not null")
    both = linked.select(*CONV, F.col("pos").alias("child"), "parent").unionByName(extra.select(*CONV, "child", "parent"))
    return both.where("parent >= 0 and parent < child").distinct()


def windowed(rows: DataFrame, size: int = 300) -> DataFrame:
    """Window number and position inside the window of a long conversation."""
    return rows.withColumns({"window": F.floor(F.col("pos") / size), "offset": F.col("pos") % size})


def unassigned(msgs: DataFrame, members: DataFrame) -> DataFrame:
    return msgs.select(*CONV, "pos").join(members.select(*CONV, "pos"), [*CONV, "pos"], "left_anti")


def fixed_point(edges: DataFrame, proposals: DataFrame, rounds: int = 3) -> DataFrame:
    """Add each round's proposals for messages that still lack a parent: (.., child, parent, round).

    ``proposals`` carries ``round``.  A conversation stops at its first round that adds nothing.
    """
    cur = materialize(edges.select(*CONV, "child", "parent", F.lit(0).alias("round")), "rounds")
    alive = None
    for n in range(1, rounds):
        new = proposals.where((F.col("round") == n) & (F.col("child") != F.col("parent")) & (F.col("parent") >= 0)).select(*CONV, "child", "parent").distinct()
        new = new.join(cur.select(*CONV, "child"), [*CONV, "child"], "left_anti")
        if alive is not None:
            new = new.join(alive, CONV, "left_semi")
        new = materialize(new.withColumn("round", F.lit(n)), "rounds")
        if new.isEmpty():
            break
        alive = new.select(*CONV).distinct()
        cur = cur.unionByName(new)
    return cur


# ---------------------------------------------------------------- pruning around sure edges


def anchor_prune(nodes: DataFrame, scored: DataFrame, tau_hi: float = 0.70, tau_lo: float = 0.45, limit: int | None = None) -> DataFrame:
    """Keep edges around sure ones.

    Edges at ``tau_hi`` are anchors, edges at ``tau_lo`` are kept, a message without any keeps its
    best.  From every anchor the search runs down from its child and up from its parent; a message
    not met whose best score stays below ``tau_hi`` becomes a root.  Without anchors in a
    conversation nothing is pruned.  Conversations above ``limit`` messages are searched by joins.
    """
    # of each message, the pairs that any threshold keeps and the best one; the others are never written
    of = [*CONV, "_blk", "i"] if "_blk" in scored.columns else [*CONV, "i"]
    nth = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "c"))
    few = scored.withColumn("_nth", nth).where((F.col("_nth") == 1) | (F.col("score") >= min(tau_lo, tau_hi)))
    scored = materialize(few.select(*CONV, "i", "c", "score", "_nth"), "scored")
    best = scored.where("_nth = 1").select(*CONV, "i", F.col("score").alias("top"), F.col("c").alias("arg"))
    rows = scored.where(F.col("score") >= tau_lo).select(*CONV, "i", "c").unionByName(best.where(F.col("top") < tau_lo).select(*CONV, "i", F.col("arg").alias("c")))
    edges = materialize(rows.select(*CONV, F.col("i").alias("child"), F.col("c").alias("parent")), "prune")
    anchors = materialize(scored.where(F.col("score") >= tau_hi).select(*CONV, F.col("i").alias("child"), F.col("c").alias("parent")), "anchors")
    down = reach(nodes, anchors.select(*CONV, F.col("child").alias("pos")), edges.select(*CONV, F.col("parent").alias("pos"), F.col("child").alias("to")), limit)
    up = reach(nodes, anchors.select(*CONV, F.col("parent").alias("pos")), edges.select(*CONV, F.col("child").alias("pos"), F.col("parent").alias("to")), limit)
    met = down.unionByName(up).distinct()
    weak = best.where(F.col("top") < tau_hi).select(*CONV, F.col("i").alias("child"))
    weak = weak.join(anchors.select(*CONV).distinct(), CONV, "left_semi")
    lost = weak.join(met.withColumnRenamed("pos", "child"), [*CONV, "child"], "left_anti")
    return edges.join(lost, [*CONV, "child"], "left_anti")


def reach(nodes: DataFrame, seeds: DataFrame, steps: DataFrame, limit: int | None = None) -> DataFrame:
    """All nodes met from the seeds along ``pos -> to`` steps: (conversation, pos)."""

    def local(nodes: DataFrame, seeds: DataFrame, steps: DataFrame) -> DataFrame:
        rows = steps.select(*CONV, "pos", "to").unionByName(seeds.select(*CONV, "pos", F.lit(SEED).cast("long").alias("to")))
        return rows.groupBy(*CONV).applyInPandas(_met, keyed_schema(rows, CONV, "pos long"))

    return by_size(nodes, [seeds, steps], CONV, limit, local, lambda n, s, e: _spread_reach(s, e))


def _closure(start: Iterable[int], onward: dict[int, list[int]]) -> set[int]:
    met = set(start)
    stack = list(met)
    while stack:
        for x in onward.get(stack.pop(), ()):
            if x not in met:
                met.add(x)
                stack.append(x)
    return met


def _ways(pos: pd.Series, to: pd.Series) -> dict[int, list[int]]:
    onward: dict[int, list[int]] = {}
    for a, b in zip(pos.tolist(), to.tolist()):
        onward.setdefault(a, []).append(b)
    return onward


def _met(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    real = pdf[pdf["to"] >= 0]
    met = _closure(pdf.loc[pdf["to"] == SEED, "pos"].tolist(), _ways(real["pos"], real["to"]))
    return pd.DataFrame([(*key[: len(CONV)], x) for x in met], columns=[*CONV, "pos"])


def _bridges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one stretch: the border nodes that its seeds meet (``to`` is ``SEED``), and steps that lead from its entries to its exits.

    Where pairs of entry and exit are fewer than the steps between them, the pairs stand for these.
    """
    real, of = pdf[pdf["to"] >= 0], lambda kind: set(pdf.loc[pdf["to"] == kind, "pos"].tolist())
    onward, back = _ways(real["pos"], real["to"]), _ways(real["to"], real["pos"])
    met, enter, leave = _closure(of(SEED), onward), of(ENTRY), of(EXIT)
    # what a node that is not met comes from is not met either
    live = _closure(enter, onward) & _closure(leave - met, back)
    steps = {(a, b) for a in live for b in onward.get(a, ()) if b in live}
    ins, outs = enter & live, leave & live
    if len(ins) * len(outs) <= len(steps):
        if len(ins) <= len(outs):
            steps = {(a, b) for a in ins for b in _closure([a], onward) & outs}
        else:
            steps = {(a, b) for b in outs for a in _closure([b], back) & ins}
    rows = [(*key[: len(CONV)], a, b) for a, b in steps if a != b] + [(*key[: len(CONV)], x, SEED) for x in met & (enter | leave)]
    return pd.DataFrame(rows, columns=[*CONV, "pos", "to"])


def _spread_reach(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """As :func:`reach`, for conversations that no task holds: by stretches of ``STRETCH`` positions.

    A task finds for one stretch what its seeds meet at its border and how its entries lead to its
    exits; :func:`_rounds` joins only these with the steps from one stretch to another.  Knowing the
    border nodes that are met, each stretch is searched once more.  So the steps inside of
    stretches, which are nearly all where parents are near, are dealt twice however long chains are.
    """
    at = lambda c: F.floor(F.col(c) / STRETCH)
    marked = lambda df, kind: df.select(*CONV, "pos", F.lit(kind).cast("long").alias("to"))
    dealt = lambda df: df.withColumn("_blk", at("pos")).groupBy(*CONV, "_blk")
    steps = steps.select(*CONV, "pos", "to").where("pos <> to")
    rows = steps.where(at("pos") == at("to")).unionByName(marked(seeds, SEED))
    with intermediates() as held:
        cross = materialize(steps.where(at("pos") != at("to")).distinct(), "cross")
        if not cross.isEmpty():
            entries = cross.select(*CONV, F.col("to").alias("pos")).distinct()
            ends = marked(cross.select(*CONV, "pos").distinct(), EXIT).unionByName(marked(entries, ENTRY))
            near = dealt(rows.unionByName(ends)).applyInPandas(_bridges, keyed_schema(rows, CONV, "pos long, to long"))
            near = materialize(near, "bridges")
            far = _rounds(near.where(F.col("to") == SEED), near.where("to >= 0").unionByName(cross))
            rows = rows.unionByName(marked(far, SEED))
    out = materialize(dealt(rows).applyInPandas(_met, keyed_schema(rows, CONV, "pos long")), "reach")
    release(out.sparkSession, held)
    return out


def _rounds(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """All nodes met from the seeds, by joins; a chain of n steps takes about log2(n) rounds.

    In each round met nodes hand on along one step; steps into met nodes and steps out of nodes that
    nothing leads to are dropped; and a step whose start has a single way in moves to that way's
    start, as both are met together or not at all.  So chains halve, and side branches that no
    seed leads to fall off; only nodes with several open ways in are walked hop by hop.
    """
    spark, into = steps.sparkSession, [*CONV, "to"]
    seen = front = materialize(seeds.select(*CONV, "pos").distinct(), "reach")
    with intermediates() as held:
        rest = steps.select(*CONV, "pos", "to").where("pos <> to").distinct()
        rest = materialize(rest.join(seen.withColumnRenamed("pos", "to"), into, "left_anti"), "steps")
    while True:
        front = materialize(rest.join(front, [*CONV, "pos"]).select(*CONV, F.col("to").alias("pos")).distinct(), "reach")
        if front.isEmpty():
            release(spark, held)
            return seen
        seen = seen.unionByName(front)
        with intermediates() as kept:
            rest = materialize(_contracted(rest, front), "steps")
        release(spark, held)
        held = kept


def _contracted(steps: DataFrame, met: DataFrame) -> DataFrame:
    """Steps into nodes that are not met, each from the first node of the chain piece that leads to it."""
    on = [*CONV, "pos"]
    left = steps.join(met.withColumnRenamed("pos", "to"), [*CONV, "to"], "left_anti")
    ways = left.groupBy(*CONV, F.col("to").alias("pos")).agg(F.count("*").alias("_n"), F.min("pos").alias("_from"))
    # a met node has no open way in, so each node is in one of the two tables at most
    starts = ways.unionByName(met.select(*on, F.lit(0).cast("long").alias("_n"), F.lit(None).cast("long").alias("_from")))
    moved = left.join(starts, on).select(*CONV, F.when(F.col("_n") == 1, F.col("_from")).otherwise(F.col("pos")).alias("pos"), "to")
    return moved.where("pos <> to").distinct()


# ---------------------------------------------------------------- tracing


def trace(msgs: DataFrame, preds: DataFrame, queries: DataFrame, max_hops: int = 10, band: int = 100) -> DataFrame:
    """For every (query_id, dataset, conv_id, pos): its parent chain and its thread context.

    Rows are (query_id, .., pos, hop, relation).  The chain follows the first unvisited parent for
    at most ``max_hops`` and records all parents on the way; ``preds`` may carry ``rank``, the
    predictor's order of a message's parents, else the smallest position comes first.  Two rounds
    then add messages within ``band`` whose predicted parent is already in the thread; messages
    with ``is_system`` (if ``msgs`` has it) stay out of that context.
    """
    key = ["query_id", *CONV]
    rank = F.col("rank").cast("long") if "rank" in preds.columns else F.col("parent")
    links = preds.where("child <> parent").select(*CONV, "child", "parent", rank.alias("_rank"))
    cur = materialize(queries.select(*key, "pos"), "trace")
    seen = cur.select(*key, "pos", F.lit(0).alias("hop"), F.lit("query").alias("relation"))
    for hop in range(1, max_hops + 1):
        up = cur.join(links.withColumnRenamed("child", "pos"), [*CONV, "pos"]).groupBy(*key, F.col("parent").alias("pos")).agg(F.min("_rank").alias("_rank"))
        new = materialize(up.join(seen.select(*key, "pos"), [*key, "pos"], "left_anti"), "trace")
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select(*key, "pos", F.lit(hop).alias("hop"), F.lit("direct-parent").alias("relation")))
        cur = new.groupBy(*key).agg(F.min_by("pos", F.struct("_rank", "pos")).alias("pos"))
    front = seen.select(*key, "pos")
    if "is_system" in msgs.columns:
        system = msgs.where("is_system").select(*CONV, F.col("pos").alias("child"))
        links = links.join(system, [*CONV, "child"], "left_anti")
    for _ in range(2):
        kids = front.withColumnRenamed("pos", "parent").join(links, [*CONV, "parent"]).where(F.abs(F.col("child") - F.col("parent")) < band)
        new = kids.select(*key, F.col("child").alias("pos")).distinct().join(seen.select(*key, "pos"), [*key, "pos"], "left_anti")
        front = materialize(new, "trace")
        seen = seen.unionByName(front.select(*key, "pos", F.lit(-1).alias("hop"), F.lit("thread-context").alias("relation")))
    return seen


# ---------------------------------------------------------------- themes


def theme_asof(msgs: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest earlier message of the same ``theme``, -1 if there is none."""
    rows = msgs.where("theme is not null").select(*CONV, "theme", "pos")
    got = last_before(rows, [*CONV, "theme"], ["pos"], F.col("pos"), "parent", limit)
    return got.where("pos > 0").select(*CONV, F.col("pos").alias("child"), F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"))


def registry(msgs: DataFrame, limit: int | None = None) -> DataFrame:
    """As ``theme_asof``, but node 0 never enters the registry."""
    return theme_asof(msgs.where("pos > 0"), limit)


def novelty_roots(msgs: DataFrame, base: DataFrame) -> DataFrame:
    """The first message of a theme is a root (-1); the others take ``base`` (child, parent)."""
    first = msgs.groupBy(*CONV, "theme").agg(F.min("pos").alias("child")).select(*CONV, "child", F.lit(True).alias("new"))
    out = base.join(first, [*CONV, "child"], "left")
    return out.select(*CONV, "child", F.when(F.col("new"), F.lit(-1).cast("long")).otherwise(F.col("parent")).alias("parent"))


def is_recalled(k: int = 8) -> Column:
    """Whether a pair (child, parent) lies in the recalled candidates: last k, same theme, or root."""
    return (F.col("parent") == -1) | (F.col("child") - F.col("parent") <= k) | (F.col("child_theme") == F.col("parent_theme"))


def restrict(preds: DataFrame, msgs: DataFrame, k: int = 8) -> DataFrame:
    """Predictions inside the recalled candidate set; the others fall back to the root option.

    Membership is tested per prediction, so the same-theme pairs are never listed.
    """
    theme = msgs.select(*CONV, "pos", "theme")
    out = preds.join(theme.select(*CONV, F.col("pos").alias("child"), F.col("theme").alias("child_theme")), [*CONV, "child"])
    out = out.join(theme.select(*CONV, F.col("pos").alias("parent"), F.col("theme").alias("parent_theme")), [*CONV, "parent"], "left")
    return out.select(*CONV, "child", F.when(is_recalled(k), F.col("parent")).otherwise(F.lit(-1).cast("long")).alias("parent"))


def recall_sizes(msgs: DataFrame, k: int = 8) -> DataFrame:
    """How many candidates (root included) each message recalls: counts, not lists."""
    from threadloom.operators.ordered import number_rows

    # same-theme messages inside the last k are counted once; by blocks, where they meet
    size = 1024
    last = Window.partitionBy(*CONV, "_blk", "theme").orderBy("pos").rangeBetween(-k, -1)
    near = with_reach(msgs.select(*CONV, "theme", "pos"), "pos", k, size).withColumn("n_near", F.when(F.col("theme").isNotNull(), F.count("*").over(last)).otherwise(0))
    near = near.where(F.col("_blk") == F.floor(F.col("pos") / size)).drop("_blk")
    out = number_rows(near, [*CONV, "theme"], ["pos"], "n_same")
    return out.select(*CONV, "pos", (1 + F.least(F.col("pos"), F.lit(k)) + F.col("n_same") - F.col("n_near")).alias("n_candidates"))

"""Prefix trie of conversations that share openings, from fingerprints that compose."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordered import fits, number_rows, running_sum
from threadloom.schema import CONV
from threadloom.session import materialize

#: Numbers of a fingerprint, each below PRIME.
LANES = 3
PRIME = 2**31 - 1
#: Characters of the piece of a list of ids that travels as one row.
PIECE = 65_536

#: Exponents are written with digits of five bits; seven of them reach 2^35 messages of one conversation.
_BITS, _DIGITS = 5, 7


@dataclass(frozen=True)
class Draw:
    """One draw of the fingerprint's random numbers."""

    seed: int
    prime: int = PRIME

    def bases(self) -> list[int]:
        rng = random.Random(self.seed)
        return [rng.randrange(self.prime // 4, self.prime - 1) for _ in range(LANES)]


DRAWS = tuple(Draw(seed) for seed in range(1, 9))


def power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo prime, digit by digit from tables of constants."""
    out = F.lit(1).cast("long")
    for k in range(_DIGITS):
        table = F.array(*[F.lit(pow(base, d << (_BITS * k), prime)).cast("long") for d in range(1 << _BITS)])
        digit = F.shiftright(exponent.cast("long"), _BITS * k).bitwiseAND((1 << _BITS) - 1)
        out = F.pmod(out * F.get(table, digit.cast("int")), F.lit(prime))
    return out


def lanes(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(LANES)]


def _running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Sums over the earlier rows of the group, one column for each value."""
    if fits(df, keys, None):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in values.items()})
    for name, value in values.items():
        df = running_sum(df, keys, [order], value, name, limit=0)
    return df


def content(messages: DataFrame, draw: Draw) -> DataFrame:
    """(dataset, conv_id, pos, author, text, t0, t1): messages with the fingerprint of author and text."""
    said = messages.where("dataset is not null and conv_id is not null").select(
        *CONV, "pos", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("author", "text")]
    )
    seed = F.lit(draw.seed)
    return said.select("*", F.xxhash64(seed, "author", "text").alias("t0"), F.xxhash64(seed + 1, "text", "author").alias("t1"))


def turn_table(messages: DataFrame, draw: Draw) -> DataFrame:
    """One row a message: its place from 0, its fingerprint and those of the prefixes before and after it.

    A prefix's fingerprint is the sum of (message x base^place): a product of the monoid of
    (sum, length) pairs, in which (a, m)(b, n) = (a + base^m b, m + n).  So a stretch is a difference
    of two prefixes, and a shift by places is a product with a power; texts are not needed again.
    """
    said = content(messages, draw).select(*CONV, F.col("pos").alias("_pos"), "author", F.sha2("text", 256).alias("_text"), F.octet_length("text").cast("long").alias("size"), "t0", "t1")
    rows = number_rows(said, CONV, ["_pos", "author", "_text"]).drop("_pos", "author", "_text")
    p = F.lit(draw.prime)
    parts = [F.col("t0"), F.shiftright("t0", 32), F.col("t1")]
    value = {f"v{k}": F.pmod((F.pmod(part, p) + 1) * power(base, draw.prime, F.col("pos")), p) for k, (part, base) in enumerate(zip(parts, draw.bases(), strict=True))}
    rows = _running(rows.withColumns(value), CONV, "pos", {b: F.col(v) for b, v in zip(lanes("b"), lanes("v"), strict=True)})
    sums = [F.pmod(F.col(f"b{k}"), p).alias(f"b{k}") for k in range(LANES)] + [F.pmod(F.col(f"b{k}") + F.col(f"v{k}"), p).alias(f"a{k}") for k in range(LANES)]
    return materialize(rows.select(*CONV, "pos", "size", "t0", "t1", *sums), "turns")


def rebuilt_plan(turns: DataFrame, heads: DataFrame, draw: Draw) -> DataFrame:
    """How each conversation is put together: base, places taken of it, own places left out, their fingerprints."""
    types = dict(turns.dtypes)
    sizes = turns.groupBy(*CONV).agg(F.count("*").alias("n"))
    asked = heads.select("dataset", F.col("conv_id").cast(types["conv_id"]).alias("conv_id"), F.struct(F.col("base_conv_id").cast(types["conv_id"]).alias("base"), F.greatest(F.coalesce(F.col("n_head").cast("long"), F.lit(0)), F.lit(0)).alias("want")).alias("_ask"))
    asked = asked.groupBy(*CONV).agg(F.min("_ask").alias("_ask"))
    plan = sizes.join(asked, CONV, "left").select(*CONV, "n", F.col("_ask.base").alias("base"), F.coalesce("_ask.want", F.lit(0)).alias("want"))
    there = sizes.select("dataset", F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    plan = plan.join(there, ["dataset", "base"], "left").withColumn("head", F.least("want", F.coalesce("_there", F.lit(0))))
    upto = lambda conv, n, name: turns.select("dataset", F.col("conv_id").alias(conv), (F.col("pos") + 1).alias(n), *[F.col(f"a{k}").alias(f"{name}{k}") for k in range(LANES)])
    plan = plan.join(upto("base", "head", "h"), ["dataset", "base", "head"], "left").join(upto("conv_id", "want", "o"), [*CONV, "want"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in (*lanes("h"), *lanes("o"))}
    back = {f"g{k}": power(pow(base, -1, draw.prime), draw.prime, F.col("want") - F.col("head")) for k, base in enumerate(draw.bases())}
    return materialize(plan.withColumns(zero | back | {"length": F.col("head") + F.greatest(F.col("n") - F.col("want"), F.lit(0))}).drop("_there"), "plan")


def member_table(turns: DataFrame, plan: DataFrame, draw: Draw) -> DataFrame:
    """One row a rebuilt conversation and depth, from 0: fingerprints of the prefix and of its parent.

    ``ref_conv_id``, ``ref_pos``: the stored message that is the last one of the prefix.
    """
    p = F.lit(draw.prime)
    root = plan.select(*CONV, F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("size"), *[F.lit(0).cast("long").alias(c) for c in ("t0", "t1", *lanes("f"), *lanes("p"))], F.lit(None).cast(dict(plan.dtypes)["conv_id"]).alias("ref_conv_id"), F.lit(None).cast("long").alias("ref_pos"))
    taken = plan.where("head > 0").select(*CONV, "base", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("head") - 1)).alias("pos"))
    stored = turns.withColumnRenamed("conv_id", "base")
    head = taken.join(stored, ["dataset", "base", "pos"]).select(*CONV, (F.col("pos") + 1).alias("depth"), "length", "size", "t0", "t1", *[F.col(f"a{k}").alias(f"f{k}") for k in range(LANES)], *[F.col(f"b{k}").alias(f"p{k}") for k in range(LANES)], F.col("base").alias("ref_conv_id"), F.col("pos").alias("ref_pos"))
    composed = lambda side, k: F.pmod(F.col(f"h{k}") + F.col(f"g{k}") * F.pmod(F.col(f"{side}{k}") - F.col(f"o{k}"), p), p)
    own = turns.join(plan.drop("n", "base"), CONV).where("pos >= want").select(*CONV, (F.col("head") + F.col("pos") - F.col("want") + 1).alias("depth"), "length", "size", "t0", "t1", *[composed("a", k).alias(f"f{k}") for k in range(LANES)], *[composed("b", k).alias(f"p{k}") for k in range(LANES)], F.col("conv_id").alias("ref_conv_id"), F.col("pos").alias("ref_pos"))
    return materialize(root.unionByName(head).unionByName(own), "members")


NODE = ["dataset", "depth", *lanes("f")]


def node_table(members: DataFrame) -> DataFrame:
    """One row a group of equal fingerprints; ``lo`` and ``hi`` differ where the group is not one prefix."""
    same = F.struct(*lanes("p"), "t0", "t1", "size")
    last = F.min(F.struct("conv_id", "ref_conv_id", "ref_pos"))
    nodes = members.groupBy(*NODE).agg(last.alias("_first"), F.count("*").alias("n_convs"), F.min(same).alias("lo"), F.max(same).alias("hi"))
    return materialize(nodes.select(*NODE, "n_convs", "lo", "hi", "_first.*", *[F.col(f"lo.{c}").alias(c) for c in (*lanes("p"), "size")]), "nodes")


def holds(messages: DataFrame, nodes: DataFrame, draw: Draw) -> bool:
    """Whether equal fingerprints mean equal prefixes.

    Messages of one fingerprint must be equal character by character; members of a node must share
    the parent's fingerprint and the last message's.  By induction over the depth all prefixes of a
    node are then equal.  Smallest and largest of each group tell, so no group is gathered.
    """
    if not nodes.where("lo <> hi").isEmpty():
        return False
    said = F.struct("author", "text")
    twice = content(messages, draw).groupBy("t0", "t1").agg(F.min(said).alias("lo"), F.max(said).alias("hi"))
    return twice.where("lo <> hi").isEmpty()


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids of a node in ascending order, comma-joined.

    The ids of a node may fill many tasks: ranges of them become pieces of text, and only the pieces
    of a node meet, one after the other.
    """
    rows = ends.select(*NODE, "conv_id", F.col("conv_id").cast("string").alias("id"))
    order = [*NODE, "conv_id"]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    shape = pa.schema([pa.field(f.name, f.type) for f in rows.limit(0).toArrow().schema])
    digest = pa.schema([*[shape.field(c) for c in NODE], pa.field("ends_sha256", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        done: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in done], shape)
        for batch in batches:
            for *at, conv, text in zip(*batch.to_pydict().values(), strict=True):
                if at != key or size >= PIECE:
                    if held:
                        done.append((*key, first, ",".join(held)))
                    key, first, held, size = at, conv, [], 0
                held.append(text)
                size += len(text) + 1
            if sum(len(r[-1]) for r in done) >= 16 * PIECE:
                yield flush()
                done.clear()
        if held:
            done.append((*key, first, ",".join(held)))
        if done:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *at, _, text in zip(*batch.to_pydict().values(), strict=True):
                if at == key:
                    state.update(b"," + text.encode())
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, r, strict=True)) for r in done], digest)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, (*key, state.hexdigest()), strict=True))], digest)

    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    short = laid.mapInArrow(pieces, schema).repartition(*NODE).sortWithinPartitions(*order)
    return short.mapInArrow(digests, ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in NODE) + ", ends_sha256 string")


def prefix_trie(messages: DataFrame, heads: DataFrame, draws: Sequence[Draw] = DRAWS) -> DataFrame:
    """The trie of rebuilt conversations: one row a distinct sequence of first messages, from none on.

    messages(dataset, conv_id, pos, author, text); heads(dataset, conv_id, base_conv_id, n_head): the
    conversation is rebuilt as the first ``n_head`` messages of the base (all if it has fewer, none
    if it is not there), then its own messages after its first ``n_head``.  Conversations without a
    row in ``heads`` stay as they are; of several rows the smallest (base, n_head) counts.  Messages
    are equal where author and text are; each dataset has a trie of its own, whose root has depth 0.

    Per node: dataset; conv_id, its smallest member, which with depth names it; depth;
    parent_conv_id, the parent's conv_id (null at the root); n_convs, its members; n_children; n_leaves,
    nodes without child in its subtree (itself included); saved_tokens, over its subtree, the bytes
    of the last message times (members - 1); n_ends and ends_sha256: members that end here and the
    digest of their ascending, comma-joined ids; ref_conv_id and ref_pos: where its last message is stored.

    No rebuilt text is made.  Prefixes are compared by fingerprints composed of those of the base's
    head and of the own rest; equality is then verified against the stored messages, and another
    draw of the fingerprint is taken if two different prefixes had met.  Sums over subtrees take one
    pass for any depth: each node is charged to its smallest member, whose own nodes are the
    end of its path.  Hot prefixes are aggregated on the map side; ids of a node's ends are hashed by ranges.

    Null authors and texts count as empty; messages of one place come by author, then by a digest of
    the text, null places first; repeated rows are repeated messages.  Rows without dataset or conv_id
    take no part.  Other columns are ignored; an empty table gives no node.
    """
    for draw in draws:
        turns = turn_table(messages, draw)
        plan = rebuilt_plan(turns, heads, draw)
        members = member_table(turns, plan, draw)
        nodes = node_table(members)
        if holds(messages, nodes, draw):
            return _tree(members, nodes)
    raise ArithmeticError("different prefixes met in every draw of the fingerprint")


def _tree(members: DataFrame, nodes: DataFrame) -> DataFrame:
    kids = nodes.where("depth > 0").groupBy("dataset", (F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(f"f{k}") for k in range(LANES)]).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.drop("lo", "hi"), "nodes")

    # a node belongs to its smallest member; what belongs to a conversation at a depth or below it
    mine = nodes.select(*CONV, "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = members.join(mine, [*CONV, "depth"], "left").select(*CONV, *NODE[1:], (-F.col("depth")).alias("_up"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaf")])
    path = _running(path, CONV, "_up", {"_saved": F.col("saved"), "_leaf": F.col("leaf")})
    total = path.groupBy(*NODE).agg(F.sum(F.col("_saved") + F.col("saved")).alias("saved_tokens"), F.sum(F.col("_leaf") + F.col("leaf")).alias("n_leaves"))

    above = nodes.select("dataset", (F.col("depth") + 1).alias("depth"), *[F.col(f"f{k}").alias(f"p{k}") for k in range(LANES)], F.col("conv_id").alias("parent_conv_id"))
    ends = members.where("depth = length")
    n_ends = ends.groupBy(*NODE).agg(F.count("*").alias("n_ends"))
    out = nodes.join(total, NODE).join(n_ends, NODE, "left").join(_joined_ids(ends), NODE, "left").join(above, ["dataset", "depth", *lanes("p")], "left")
    return out.select(
        *CONV, "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "ref_conv_id", "ref_pos",
    )

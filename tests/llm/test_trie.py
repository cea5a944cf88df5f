"""op13: the trie against brute force on random conversations, weak fingerprints, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import trie
from threadloom.llm.trie import DRAWS, Draw, power, prefix_trie

MSG = "dataset string, conv_id string, pos long, author string, text string"
HEAD = "dataset string, conv_id string, base_conv_id string, n_head int"


def brute(rows, heads):
    """(dataset, conv_id, depth) -> the other columns, from the rebuilt texts themselves."""
    convs, plan = {}, {}
    for d, c, pos, author, text in rows:
        if d is not None and c is not None:
            text = text or ""
            convs.setdefault((d, c), []).append((pos is not None, pos, author or "", hashlib.sha256(text.encode()).hexdigest(), text))
    for d, c, base, n in heads:
        ask = (base is not None, base, max(n or 0, 0))
        plan[d, c] = min(plan.get((d, c), ask), ask)
    own = {k: [(m[2], m[4]) for m in sorted(v, key=lambda m: (m[0], m[1] or 0, m[2], m[3]))] for k, v in convs.items()}
    nodes, ends = {}, {}
    for (d, c), turns in own.items():
        _, base, n = plan.get((d, c), (False, None, 0))
        whole = tuple(own.get((d, base), [])[:n] + turns[n:])
        ends.setdefault((d, whole), []).append(c)
        for k in range(len(whole) + 1):
            nodes.setdefault((d, whole[:k]), []).append(c)
    out = {}
    kids = {}
    for d, p in nodes:
        if p:
            kids.setdefault((d, p[:-1]), []).append(p)
    for (d, p), members in nodes.items():
        below = [q for e, q in nodes if e == d and q[: len(p)] == p]
        saved = sum((len(nodes[d, q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        leaves = sum((d, q) not in kids for q in below)
        stop = sorted(ends.get((d, p), []))
        up = min(nodes[d, p[:-1]]) if p else None
        out[d, min(members), len(p)] = (up, len(members), len(kids.get((d, p), [])), leaves, saved, len(stop), hashlib.sha256(",".join(stop).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r.dataset, r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.n_ends, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n=40, words=3):
    rng = random.Random(seed)
    rows, heads = [], []
    for c in range(n):
        d = rng.choice(["a", "a", "b"])
        for pos in range(rng.randrange(1, 9)):
            rows.append((d, f"c{c}", pos, rng.choice(["u", "v", None]), rng.choice([None, "", "é" * rng.randrange(1, words), "x"])))
        if rng.random() < 0.8:
            heads.append((d, f"c{c}", rng.choice([f"c{c - c % 5}", "c0", "gone", None]), rng.choice([0, 1, 2, 3, 8, None, -1])))
    return rows, heads + heads[:3] + [("a", "nobody", "c0", 2), (None, "c1", "c0", 1)]


@pytest.mark.parametrize("seed", [1])
def test_brute_force(spark, seed):
    rows, heads = conversations(seed)
    found = prefix_trie(spark.createDataFrame(rows, MSG), spark.createDataFrame(heads, HEAD))
    assert got(found) == brute(rows, heads)


def test_weak_fingerprints_are_found_out(spark, monkeypatch):
    rows, heads = conversations(3, 25)
    msgs, plan = spark.createDataFrame(rows, MSG), spark.createDataFrame(heads, HEAD)
    tried = []
    real = trie.holds
    monkeypatch.setattr(trie, "holds", lambda *a: tried.append(real(*a)) or tried[-1])
    assert got(prefix_trie(msgs, plan, [Draw(1, 5), DRAWS[0]])) == brute(rows, heads)
    assert tried == [False, True]
    with pytest.raises(ArithmeticError):
        prefix_trie(msgs, plan, [Draw(1, 5)])


def test_equal_fingerprints_of_messages_are_compared(spark, monkeypatch):
    rows = [("a", "1", 0, "u", "x"), ("a", "2", 0, "u", "y")]
    same = lambda m, draw: m.select("*", F.lit(1).cast("long").alias("t0"), F.lit(2).cast("long").alias("t1"))
    monkeypatch.setattr(trie, "content", same)
    with pytest.raises(ArithmeticError):
        prefix_trie(spark.createDataFrame(rows, MSG), spark.createDataFrame([], HEAD))


def test_long_and_hot_conversations(spark, monkeypatch):
    """Groups above the window's size, ids of one node over several pieces, deep paths."""
    rows = [("a", f"{c:04}", p, "u", f"m{p}") for c in range(120) for p in range(3)]
    rows += [("a", f"long{k}", p, "u", f"m{p}" if p < 100 else f"n{k}") for k in range(2) for p in range(300)]
    heads = [("a", "0007", "long0", 250), ("a", "long1", "0001", 2)]
    monkeypatch.setattr(trie, "PIECE", 64)
    want = brute(rows, heads)
    monkeypatch.setattr("threadloom.operators.ordered.GROUP_ROWS", 50)
    assert got(prefix_trie(spark.createDataFrame(rows, MSG), spark.createDataFrame(heads, HEAD))) == want


def test_odd_rows(spark, odd, nothing):
    rows = [("a", "1", None, None, None), ("a", "1", None, None, None), ("a", "1", 0, "u", "t" * 100_000), (None, "1", 0, "u", "x"), ("a", None, 0, "u", "x"), ("b", "1", 0, "u", "t")]
    msgs = spark.createDataFrame([(*r, 1, 2) for r in rows], MSG + ", depth int, f0 int")
    none = spark.createDataFrame([], HEAD)
    assert got(prefix_trie(msgs, none)) == brute(rows, [])
    kept = [(r.dataset, r.conv_id, r.pos, r.author, r.text) for r in odd.collect()]
    assert got(prefix_trie(odd, none)) == brute(kept, [])
    assert prefix_trie(nothing, none).count() == 0


def test_references_point_to_the_last_message(spark):
    rows = [("a", "1", 5, "u", "x"), ("a", "1", 9, "v", "y"), ("a", "2", 0, "u", "p"), ("a", "2", 1, "u", "z")]
    out = prefix_trie(spark.createDataFrame(rows, MSG), spark.createDataFrame([("a", "2", "1", 1)], HEAD)).collect()
    at = {(r.conv_id, r.depth): (r.ref_conv_id, r.ref_pos) for r in out}
    assert at == {("1", 0): (None, None), ("1", 1): ("1", 0), ("1", 2): ("1", 1), ("2", 2): ("2", 1)}


def test_power(spark):
    exps = [0, 1, 31, 32, 1000, 2**33 + 17]
    df = spark.createDataFrame([(e,) for e in exps], "e long")
    assert [r[0] for r in df.select(power(7, 2**31 - 1, F.col("e"))).collect()] == [pow(7, e, 2**31 - 1) for e in exps]


def test_chat_messages(spark, sf):
    """The library's own turns: without heads every conversation is a path of its own messages."""
    from threadloom.sources.events import read_turns

    msgs = read_turns(spark, sf)
    found = prefix_trie(msgs, spark.createDataFrame([], HEAD))
    rows = [tuple(r) for r in msgs.select("dataset", "conv_id", "pos", "author", "text").collect()]
    assert got(found) == brute(rows, [])

"""op5 against comparing all pairs in memory, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa

from threadloom.llm import near
from threadloom.llm.links import link_components


def sets_of(rows, n):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = {}
    for key, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
        out[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def components(sets, percent=80):
    top = {k: k for k in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def copies(seed, groups=12, size=14):
    """Groups of copies with more and more edits, so that links are chains as well as stars."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 12, 40, 150]))]
        for _ in range(size):
            rows.append((len(rows), " ".join(base).title() if rng.random() < 0.3 else " ".join(base)))
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(len(base))] = f"v{rng.randrange(300)}"
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two")]


def test_components(spark):
    for seed, n in ((1, 4), (2, 5)):
        rows = copies(seed)
        want, sets = components(sets_of(rows, n)), sets_of(rows, n)
        got = near.near_duplicates(spark.createDataFrame(rows, "msg_id long, text string"), n).collect()
        assert {r.msg_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), want[k], want[k] == k) for k in want}


def test_blocks_of_a_large_bucket_agree(spark, monkeypatch):
    rows = copies(5, groups=3, size=40)
    df = spark.createDataFrame(rows, "msg_id long, text string")
    want = components(sets_of(rows, 4))
    monkeypatch.setattr(near, "BLOCK", 5)
    assert {r.msg_id: r.component_id for r in near.near_duplicates(df, 4).collect()} == want


def test_odd_rows(odd, nothing):
    got = near.near_duplicates(odd).collect()
    by = {r.msg_id: r for r in got}
    assert len(got) == 13 and by[2].kept and by[3].n_shingles == 0 and by[4].component_id == 4
    assert (by[6].component_id, by[6].kept, by[5].kept) == (5, False, True)
    assert by[None].component_id is None and by[None].kept
    assert [(r.component_id, r.kept) for r in got if r.msg_id == 7] == [(7, True)] * 2
    assert near.near_duplicates(nothing).collect() == []


def test_estimates_follow_the_similarity():
    rng = random.Random(4)
    for n, same in ((400, 0.8), (400, 0.5), (2000, 0.9), (300, 0.0)):
        shared = int(2 * n * same / (1 + same))
        a = [f"a{rng.random()}" for _ in range(shared)]
        texts = [" ".join(a + [f"b{k}{rng.random()}" for _ in range(n - shared)]) for k in range(2)]
        row, key = near.shingle_sets(pa.chunked_array([texts]), 1)
        regs = near.registers(row, key, 2)
        assert abs(near.similarity(regs[:1], regs[1:], np.array([n]), np.array([n]))[0] - same) < near.SLACK


def test_small_sets_fill_all_registers():
    row, key = near.shingle_sets(pa.chunked_array([["just one", "", None]]), 5)
    regs = near.registers(row, key, 3)
    assert (regs[0] == regs[0][0]).all() and (regs[1:] == 0xFFFF).all()


def test_link_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.comp for r in link_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    assert link_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_other_keys_and_repeated_ids(spark):
    """String ids, ids that conversations share, many null ids: texts alone decide."""
    rng = random.Random(43)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    own = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    near_copy = lambda: " ".join([*base[:59], f"x{rng.randrange(10**6)}"])
    rows = [("d", "a", 0, "m0", " ".join(base)), ("d", "b", 0, "m0", near_copy()), ("d", "b", 1, "m1", own()), ("d", "c", 0, "m0", own())]
    rows += [(None, None, None, None, near_copy() if k % 2 else own()) for k in range(10)]
    rows += [(None, None, None, None, rows[4][4])] * 3
    df = spark.createDataFrame(rows, "dataset string, conv_id string, pos int, msg_id string, text string").repartition(4)
    got = near.near_duplicates(df).collect()
    assert len(got) == 17 and sum(r.kept for r in got) == 11  # own: 2 + 5 and 3 more rows of one of them, one of all near copies
    assert {r.component_id for r in got if r.msg_id == "m1"} == {"m1"} and {r.component_id for r in got if r.msg_id == "m0"} == {None, "m0"}
    got = near.near_duplicates(df.where("conv_id is not null"), key=["dataset", "conv_id", "pos"]).collect()
    by = {(r.conv_id, r.pos): (tuple(r.component_id), r.kept) for r in got}
    assert by == {("a", 0): (("d", "a", 0), True), ("b", 0): (("d", "a", 0), False), ("b", 1): (("d", "b", 1), True), ("c", 0): (("d", "c", 0), True)}

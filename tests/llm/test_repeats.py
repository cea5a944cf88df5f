"""op2 and op8 against counting every window in memory."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import slices, substrings, suffixes
from threadloom.llm.ragged import rolling, sliding_min, split_words


def first_places(units: dict, window: int) -> dict:
    first = {}
    for key, text in sorted(units.items()):
        for k in range(len(text) - window + 1):
            first.setdefault(tuple(text[k : k + window]), (key, k))
    return first


def covered(units: dict, window: int) -> dict:
    first, out = first_places(units, window), {}
    for key, text in units.items():
        out[key] = [False] * len(text)
        for k in range(len(text) - window + 1):
            if first[tuple(text[k : k + window])] != (key, k):
                out[key][k : k + window] = [True] * window
    return out


def words(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def corpus(seed: int, vocabulary: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    draw = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    shared = [draw(40) for _ in range(4)]
    rows = [(i, " ".join(draw(rng.randrange(60)) + rng.choice(shared)[rng.randrange(10) :] + draw(rng.randrange(30)))) for i in range(0, 120, 2)]
    rows += [(i, rows[i // 3][1].replace(" ", rng.choice([" ", "\n", " \t"]))) for i in range(1, 60, 2)]
    return [*rows, (200, "ha " * 90), (201, None), (202, ""), (203, "ha " * 25)]


@pytest.mark.parametrize("window", [20, 7])
def test_words(spark, window):
    rows = corpus(window, 50)
    got = substrings.drop_repeated_passages(spark.createDataFrame(rows, "msg_id long, text string"), window, 3).collect()
    units = {k: words(t) for k, t in rows}
    want = covered(units, window)
    assert len(got) == len(rows)
    for r in got:
        kept = b" ".join(w for w, c in zip(units[r.msg_id], want[r.msg_id]) if not c).decode()
        assert (r.n_words, r.n_removed, r.kept_text) == (len(units[r.msg_id]), sum(want[r.msg_id]), kept)


@pytest.mark.parametrize("window", [100, 40])
def test_bytes(spark, window):
    rows = [*corpus(window, 400), (300, "ab" * 300), (301, "é" * 120)]
    got = suffixes.drop_repeated_strings(spark.createDataFrame(rows, "msg_id long, text string"), window, 8).collect()
    units = {k: (t or "").encode() for k, t in rows}
    want = covered(units, window)
    for r in got:
        flags = bytes(want[r.msg_id])
        kept = bytes(b for b, c in zip(units[r.msg_id], flags) if not c)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(flags), sum(flags), len(re.findall(b"\1+", flags)))
        assert bytes(r.kept_bytes) == kept


def test_few_buckets_and_many_tasks_agree(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(3, 60), "msg_id long, text string").repartition(7)
    a = {r.msg_id: r.kept_text for r in substrings.drop_repeated_passages(rows).collect()}
    monkeypatch.setattr(substrings, "buckets_for", lambda df: 13)
    assert a == {r.msg_id: r.kept_text for r in substrings.drop_repeated_passages(rows).collect()}


def test_odd_rows(odd, nothing):
    got = substrings.drop_repeated_passages(odd.withColumnRenamed("author", "n_words")).collect()
    by = {r.msg_id: r for r in got}
    assert len(got) == 13 and by[2].kept_text == "" and by[3].n_words == 0 and by[4].n_words == 0
    assert by[5].n_removed < by[5].n_words == by[6].n_removed == 60_000
    assert [r.n_removed for r in got if r.msg_id == 7] == [0, 0]
    assert by[None].n_words == 10 and by[5]._at == "y" and by[1].score == "x"
    assert substrings.drop_repeated_passages(nothing).collect() == []
    got = {r.msg_id: r for r in suffixes.drop_repeated_strings(odd.withColumnRenamed("author", "n_bytes")).collect()}
    assert got[8].n_removed == 49_999 and got[8].n_spans == 1 and got[2].n_bytes == 0 and bytes(got[4].kept_bytes).strip() == b""
    assert got[6].n_removed == got[6].n_bytes and got[7].n_removed == 0
    assert suffixes.drop_repeated_strings(nothing).collect() == []
    with pytest.raises(ValueError):
        suffixes.drop_repeated_strings(nothing, 20)


def test_collisions_are_split_by_content():
    text = [b"a b c d", b"a b c e", b"a b c d"]
    w = split_words(np.frombuffer(b"".join(text), np.uint8), np.array([0, 7, 14, 21]))
    group = substrings._exact(w, np.array([0, 4, 8]), np.zeros(3, np.uint64), 4)
    assert group[0] == group[2] != group[1]


@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_split_words(texts):
    raw = [t.encode() for t in texts]
    w = split_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
    assert got == [x for t in raw for x in t.split()]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in raw]
    same = Counter(zip(got, w.hashes().tolist()))
    assert len(same) == len(set(got))


@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=40), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_windows(values, n):
    x = np.array(values, np.uint64)
    assert sliding_min(x, n).tolist() == [min(values[i : i + n]) for i in range(len(values) - n + 1)]
    want = [sum(v * pow(0x9E3779B97F4A7C15, n - 1 - k, 2**64) for k, v in enumerate(values[i : i + n])) % 2**64 for i in range(len(values) - n + 1)]
    assert rolling(x, n).tolist() == want


def test_cover_brings_any_two_places_in():
    assert suffixes.shifts().max() < suffixes.PERIOD


@given(st.integers(0, 10_000), st.integers(31, 64))
@settings(max_examples=25, deadline=None)
def test_sorted_suffixes(seed, window):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(150))
    data = b"".join(base[rng.randrange(100) :] for _ in range(5)) + bytes(window + 80)
    arr = np.frombuffer(data, np.uint8)
    eight = suffixes.eights(arr)
    at = np.arange(len(data) - window - 80)
    got = suffixes.sort_block(at, eight, suffixes.cover_ranks(eight, window), suffixes.shifts())
    keys = [data[i : i + window] for i in got]
    assert keys == sorted(keys)
    alone = Counter(data[i : i + window] for i in at)
    assert {i for i in at if alone[data[i : i + window]] > 1} <= set(got.tolist())


def test_pack_round_trip():
    cols = {"at": np.array([3, 3, 9]), "tag": np.array([1, -2, 3]), "start": np.array([0, 70000, 5]), "n": np.array([1, 2, 3]), "low": np.array([2**32 - 1, 0, 7], np.uint32), "multi": np.array([True, False, True])}
    got = slices._unpack(slices._pack(cols, slices._PLACE), slices._PLACE)
    assert all(got[k].tolist() == [int(x) for x in v] for k, v in cols.items())
    assert slices._parted(slices._join([b"a", b"", b"bc"])) == [b"a", b"", b"bc"]


def test_buckets_without_a_repeat(spark, monkeypatch):
    """Slices that share a minimiser but no window, and buckets with nothing at all."""
    rng = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(8))
    rows = [(i, " ".join(f"u{rng.random()}" for _ in range(14)) + f" {shared} " + " ".join(f"v{rng.random()}" for _ in range(14))) for i in range(25)]
    df = spark.createDataFrame(rows, "msg_id long, text string")
    for parts in (1, 40):
        monkeypatch.setattr(substrings, "buckets_for", lambda x, parts=parts: parts)
        monkeypatch.setattr(suffixes, "buckets_for", lambda x, parts=parts: parts)
        assert {r.n_removed for r in substrings.drop_repeated_passages(df).collect()} == {0}
        assert {r.n_removed for r in suffixes.drop_repeated_strings(df, 60, 8).collect()} == {0}


def hot_corpus(copies: int) -> list[tuple[int, str]]:
    """One short phrase, one passage and one edge of a passage in every row, each between words of its own."""
    rng = random.Random(31)
    own = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage, edge = own(40), own(12)
    rows = [(i, f"{own(30)} the very same phrase here {own(30)} {passage} {own(9)} {edge} {'end ' * 12}") for i in range(copies)]
    return [*rows, (copies, "ha " * 150), (copies + 1, "ha " * 130), (3, rows[3][1])]


def test_hot_minimisers_are_dealt_by_window(spark, monkeypatch):
    """No bucket holds the slices of a common minimiser, and the result is that of counting every window."""
    monkeypatch.setattr(slices, "HOT_SAMPLE", 1)
    rows = hot_corpus(60)
    df = spark.createDataFrame(rows, "msg_id long, text string").repartition(5)
    monkeypatch.setattr(substrings, "buckets_for", lambda x: 9)
    monkeypatch.setattr(suffixes, "buckets_for", lambda x: 9)
    for limit in (0, 2_000, 1 << 40):
        monkeypatch.setattr(slices, "HOT_BYTES", limit)
        units = {k: words(t) for k, t in rows}
        want = covered(units, 20)
        for r in substrings.drop_repeated_passages(df).collect():
            assert (r.n_removed, r.kept_text.encode()) == (sum(want[r.msg_id]), b" ".join(w for w, c in zip(units[r.msg_id], want[r.msg_id]) if not c))
        units = {k: t.encode() for k, t in rows}
        want = covered(units, 100)
        for r in suffixes.drop_repeated_strings(df).collect():
            assert bytes(r.kept_bytes) == bytes(b for b, c in zip(units[r.msg_id], want[r.msg_id]) if not c)


def test_a_bucket_gets_a_bounded_part_of_a_hot_minimiser(spark, monkeypatch):
    monkeypatch.setattr(slices, "HOT_SAMPLE", 1)
    monkeypatch.setattr(slices, "HOT_BYTES", 4_000)
    rows = slices.placed(spark.createDataFrame(hot_corpus(120), "msg_id long, text string"))
    cut = lambda raw, off: substrings.super_kmers(raw, off, 20, 4)
    dealt = slices.deal(rows, cut, 20, 16, lambda s: substrings.single_windows(s, 20)).collect()
    held, lone = Counter(), Counter()
    for r in dealt:
        for low in slices._unpack(r.places, slices._PLACE)["low"].tolist():
            held[low] += 1
        lone[r.part] += len(slices._unpack(r.hot, slices._HOT)["at"])
    assert max(held.values()) < 60 and sum(lone.values()) > 1000
    assert max(lone.values()) < sum(lone.values()) / 4


@pytest.fixture(scope="module")
def library_messages(spark):
    """Messages as the sources give them: ids are strings that conversations share, some keys are null."""
    rng = random.Random(41)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    own = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(15))
    rows = [("d", f"c{k}", pos, f"m{pos}", f"{passage} {own()}" if pos == 0 else own()) for k in range(4) for pos in range(3)]
    rows += [(None, None, None, None, f"{passage} {own()}") for _ in range(4)]
    return spark.createDataFrame(rows, "dataset string, conv_id string, pos int, msg_id string, text string").repartition(3)


def test_messages_of_the_library(library_messages):
    """Ids that repeat across conversations are different places: the passage stays at its first one alone."""
    got = substrings.drop_repeated_passages(library_messages).collect()
    assert len(got) == 16 and sorted(r.n_removed for r in got) == [0] * 9 + [40] * 7
    kept = [r for r in got if r.n_words == 55 and not r.n_removed]
    assert [r.conv_id for r in kept] == [None]  # nulls are first
    ordered = library_messages.where("conv_id is not null")
    got = {(r.conv_id, r.pos): r.n_removed for r in substrings.drop_repeated_passages(ordered).collect()}
    assert {k for k, n in got.items() if n} == {("c1", 0), ("c2", 0), ("c3", 0)}
    assert {(r.conv_id, r.pos) for r in suffixes.drop_repeated_strings(ordered).collect() if r.n_removed} == {("c1", 0), ("c2", 0), ("c3", 0)}


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_any_type_of_id(spark, kind):
    rows = spark.createDataFrame(corpus(20, 50), "msg_id int, text string")
    want = {r.msg_id: r.kept_text for r in substrings.drop_repeated_passages(rows).collect()}
    as_kind = {"string": "lpad(msg_id, 5, '0')", "date": "date_add(date'2020-01-01', msg_id)"}.get(kind, f"cast(msg_id as {kind})")
    got = substrings.drop_repeated_passages(rows.selectExpr(f"{as_kind} as msg_id", "text", "msg_id as number"))
    assert dict(got.dtypes)["msg_id"] == kind and {r.number: r.kept_text for r in got.collect()} == want


def test_repeated_ids_with_different_texts(spark):
    """A third of all rows without an id, each of its own text: all but one lose what they share."""
    rng = random.Random(42)
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"{passage} " + " ".join(f"u{rng.random()}" for _ in range(12))) for k in range(60)]
    got = substrings.drop_repeated_passages(spark.createDataFrame(rows, "msg_id long, text string")).collect()
    assert Counter(r.n_removed for r in got) == {0: 1, 25: 59} and next(r.msg_id for r in got if not r.n_removed) is None


@pytest.mark.parametrize("size", [150, 1_000])
def test_long_texts_are_cut_in_pieces_that_lose_no_window(size):
    rng = random.Random(size)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)).encode() for n in (3, 700, 0, 20, 19, 2_000, 25)] + [b" \n " * 400, b"x" * 3_000, b" lead " + b"ha " * 900]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def units(cut, single):
        s = cut(raw, off)
        assert all(n == len(single(x)) for x, n in zip(s.text, s.n.tolist(), strict=True))
        return [(r, a + k, w) for x, r, a in zip(s.text, s.row.tolist(), s.start.tolist(), strict=True) for k, w in enumerate(single(x))]

    for cut, split, single in (
        (lambda a, b: substrings.super_kmers(a, b, 20, 4), lambda t, n: substrings.word_pieces(t, n, 20), lambda s: substrings.single_windows(s, 20)),
        (lambda a, b: suffixes.cut_bytes(a, b, 100, 16), lambda t, n: suffixes.byte_pieces(t, n, 100), lambda s: [s[k : k + 100] for k in range(len(s) - 99)]),
    ):
        assert units(slices.in_pieces(cut, split, size), single) == units(cut, single)


def test_arrays_of_a_long_text_stay_small():
    text = np.frombuffer(random.Random(1).randbytes(16_000_000), np.uint8)
    cut = slices.in_pieces(lambda raw, off: suffixes.cut_bytes(raw, off, 100, 16), lambda t, n: suffixes.byte_pieces(t, n, 100))
    tracemalloc.start()
    try:
        s = cut(text, np.array([0, len(text)]))
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert s.n.sum() == len(text) - 99
    assert peak - held < 200_000_000  # whole: more than 50 bytes of arrays for each byte of text

"""op10: exact and edited passages, clean texts, brute-force alignment, odd rows."""

import random

import numpy as np

from threadloom.llm import contamination as cont

LETTERS = "etaoinshrdlucmfwyp"


def text(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9))) for _ in range(n))


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        p, how = rng.randrange(len(s)), rng.random()
        if how < 0.4:
            s[p] = "Q"
        elif how < 0.7:
            s.insert(p, "z")
        else:
            del s[p]
    return "".join(s)


def norm(s):
    return " ".join(s.lower().split())


def fewest_edits(passage, text):
    """Fewest edits of the passage anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        nxt = [i]
        for j, b in enumerate(text, 1):
            nxt.append(min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (a != b)))
        row = nxt
    return min(row)


def test_against_alignment_of_everything():
    rng = random.Random(2)
    items = [(k, text(rng, 30)) for k in range(6)]
    index = cont.passages(items)
    texts = []
    for _ in range(25):
        piece = edited(rng, rng.choice(items)[1], rng.choice([0, 2, 5, 9, 14, 30]))
        texts.append(text(rng, rng.randrange(5)) + " " + piece[rng.randrange(40) :] + "  \n" + text(rng, rng.randrange(8)))
    got = cont.matched(texts, index)
    for t, found in zip(texts, got):
        want = set()
        for k in range(len(index["size"])):
            p = "".join(map(chr, index["codes"][index["first"][k] : index["first"][k] + index["size"][k]].tolist()))
            if fewest_edits(p, f" {norm(t)} ") <= index["edits"][k]:
                want.add(int(index["item"][k]))
        assert {m["item_id"] for m in found} == want
        for m in found:
            assert fewest_edits(norm(t)[m["start"] : m["stop"]], norm(dict(items)[m["item_id"]])) <= 3 * max(m["edits"], 1) + 1


def test_partial_passages_are_found_and_clean_texts_are_not():
    rng = random.Random(3)
    items = [(k, text(rng, 60)) for k in range(10)]
    index = cont.passages(items)
    need = cont.PASSAGE + cont.STEP - 1
    for _, item in items:
        at = rng.randrange(len(item) - need)
        assert cont.matched([text(rng, 20) + " " + item[at : at + need].upper() + " " + text(rng, 20)], index)[0]
    assert not any(cont.matched([text(rng, 400) for _ in range(40)], index))


def test_pieces_of_the_benchmark_agree(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, text(rng, 40)) for k in range(8)]
    rows = [(k, text(rng, 10) + " " + items[k % 8][1] + " " + items[(k + 1) % 8][1]) for k in range(12)] + [(99, text(rng, 50))]
    msgs, bench = spark.createDataFrame(rows, "msg_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: {r.msg_id: (r.contaminated, r.n_items, sorted(m.item_id for m in r.matches)) for r in cont.find_contamination(msgs, bench).collect()}
    whole = read()
    assert whole[99] == (False, 0, []) and all(whole[k][:2] == (True, 2) for k in range(12))
    monkeypatch.setattr(cont, "PIECE_CHARS", 300)
    assert read() == whole


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "The quick  brown fox jumps over the lazy dog and runs far away into"), (2, None), (None, ""), (3, "short"), (3, "x" * 400)], "item_id long, text string")
    got = cont.find_contamination(odd.withColumnRenamed("author", "matches"), bench).collect()
    by = {r.msg_id: r for r in got}
    assert len(got) == 13 and {k for k, r in by.items() if r.contaminated} == {1, 8}
    assert [(m.item_id, m.edits) for m in by[1].matches] == [(1, 0)] and by[2].matches == []
    assert cont.find_contamination(nothing, bench).collect() == []
    assert not any(r.contaminated for r in cont.find_contamination(odd, bench.limit(0)).collect())


def test_align_does_not_cross_texts():
    index = cont.passages([(1, "abcdefghijklmnopqrstuvwx" * 2)])
    assert cont.matched(["abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwx"], index) == [[], []]
    assert np.all(index["need"] >= 1)


def replaced(rng, s, every):
    """Two words of five or more letters replaced in every ``every`` characters."""
    words, at, left = s.split(" "), 0, {}
    for k, w in enumerate(words):
        if len(w) >= 5:
            left.setdefault(at // every, []).append(k)
        at += len(w) + 1
    for ks in left.values():
        for k in rng.sample(ks, min(2, len(ks))):
            words[k] = "".join(rng.choice("bgjkqvxz") for _ in words[k])
    return " ".join(words)


def test_excerpts_at_any_offset():
    rng = random.Random(6)
    items = [(k, text(rng, 50)) for k in range(8)]
    index = cont.passages(items)
    texts, want = [], []
    for k in range(300):
        key, item = rng.choice(items)
        item = norm(item)
        n = rng.choice([50, 58, 75, 93, 110, 134])
        at = rng.randrange(len(item) - n)
        piece = item[at : at + n]
        if k % 3 == 1:
            for p in rng.sample(range(50), 3):
                piece = piece[:p] + "q" + piece[p + 1 :]
        elif k % 3 == 2:  # replaced words outside 50 characters that stay
            keep = rng.randrange(n - 49)
            piece = replaced(rng, piece[:keep], 100) + piece[keep : keep + 50] + replaced(rng, piece[keep + 50 :], 100)
        texts.append(text(rng, rng.randrange(30)) + "! " + piece + " !" + text(rng, rng.randrange(30)))
        want.append(key)
    got = cont.matched(texts, index)
    assert all(key in {m["item_id"] for m in found} for key, found in zip(want, got))
    assert all(cont.matched([t], index) == [found] for t, found in zip(texts[:30], got))


def test_items_with_replaced_words():
    """Of whole items with two words replaced in every 100 characters most are found."""
    rng = random.Random(8)
    items = [(k, text(rng, 50)) for k in range(100)]
    index = cont.passages(items)
    found = cont.matched([text(rng, 20) + " " + replaced(rng, norm(t), 100) + " " + text(rng, 20) for _, t in items], index)
    n = sum(k in {m["item_id"] for m in f} for (k, _), f in zip(items, found))
    print("found", n)
    assert n >= 60


def test_parts_of_an_item_in_neighbouring_texts():
    rng = random.Random(7)
    item = norm(text(rng, 60))
    index = cont.passages([(1, item)])
    got = cont.matched([item[:120], item[120:], item[:40], item[40:80], "of " + item[200:]], index)
    assert [len(f) for f in got] == [1, 1, 0, 0, 1]

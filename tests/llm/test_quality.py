"""op6: base metrics against Python, sketches, fences, odd rows."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm.quality import base_metrics, cell, fences, quality_rules, sketches


def metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(win)
    hit = {i + k for i, w in enumerate(win) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    bad = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit), bad


def test_base_metrics(spark, odd):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(["a ", "b ", "cc ", "\n", "é# ", "\t|"]) for _ in range(rng.randrange(120)))) for k in range(150)]
    rows += [(r.msg_id, r.text) for r in odd.collect()]
    cols = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in base_metrics(spark.createDataFrame(rows, "msg_id long, text string")).collect():
        assert tuple(r[c] for c in cols) == metrics(r.text)


def test_cells(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 12345, 2**40 + 7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(cell(F.col("v"))).collect()]
    assert all(c <= v < c + max(1, c / 16) for v, c in zip(values, got)) and got[:4] == [0, 1, 31, 32]


def test_sketches_merge_and_small_groups_pool(spark):
    rng = random.Random(6)
    rows = [("en" if k % 2 else None, f"s{k % 5 if k < 900 else 7 + k % 2}", False, rng.randrange(300, 700), 0, 0, 0) for k in range(960)]
    df = spark.createDataFrame(rows, "lang string, dataset string, base_failed boolean, word_length long, symbol_rate long, dup_line_rate long, repeat_rate long")
    whole = {tuple(r) for r in sketches(df).collect()}
    halves = sketches(df.where("word_length % 2 = 0")).unionAll(sketches(df.where("word_length % 2 = 1")))
    assert whole == {tuple(r) for r in halves.groupBy("lang", "dataset", "metric", "cell").agg(F.sum("n")).collect()}
    groups = df.groupBy("lang", "dataset").agg(F.count("*").alias("n"))
    got = {(r._l, r._d): r for r in fences(sketches(df), groups).collect()}
    assert len(got) == groups.count()
    q = sorted(r[3] for r in rows if r[0] == "en" and r[1] in ("s1", "s3", "s8") or r[0] == "en")
    assert got["en", "s7" if ("en", "s7") in got else "s8"].word_length_hi > q[len(q) * 3 // 4] > got["en", "s1"].word_length_lo


def test_fences_have_no_step_and_hold_the_quartiles(spark):
    """A group that grows by one message moves its fences a little; even a small one lies within its own."""
    rng = random.Random(8)
    other = [("en", "big", 400 + rng.randrange(100), 0, 0, 0) for _ in range(300)]
    mine = [("en", "small", 900 + rng.randrange(50), 0, 5, 0) for _ in range(130)]
    schema = "lang string, dataset string, word_length long, symbol_rate long, dup_line_rate long, repeat_rate long"
    seen = []
    for n in (1, 3, 99, 100, 101, 130):
        df = spark.createDataFrame(other + mine[:n], schema).withColumn("base_failed", F.lit(False))
        table = {r._d: r for r in fences(sketches(df), df.groupBy("lang", "dataset").agg(F.count("*").alias("n"))).collect()}
        seen.append((table["small"].word_length_lo, table["small"].word_length_hi, table["small"].dup_line_rate_hi))
        values = sorted(r[2] for r in mine[:n])
        assert seen[-1][0] <= values[len(values) // 4] and values[len(values) * 3 // 4] - 32 <= seen[-1][1] and seen[-1][2] >= 5
    assert all(abs(a - b) <= 32 for x, y in zip(seen[2:4], seen[3:5]) for a, b in zip(x, y))


def test_thresholds_follow_the_group(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(600):
        n = 4 if k % 2 else 12
        rows.append((k, "x" if k % 2 else "y", "en", " ".join(word(rng.randrange(n - 1, n + 2)) for _ in range(60))))
    rows += [(1000, "x", "en", " ".join(word(12) for _ in range(60))), (1001, "y", "en", " ".join(word(12) for _ in range(60)))]
    rows += [(1002, "x", "en", " ".join(word(4) + "%%%" for _ in range(60)))]
    got = {r.msg_id: r for r in quality_rules(spark.createDataFrame(rows, "msg_id long, dataset string, lang string, text string")).collect()}
    assert not got[1000].kept and got[1001].kept and not got[1002].kept
    assert sum(got[k].kept for k in range(600)) > 590


def test_odd_rows(odd, nothing):
    got = quality_rules(odd.withColumnRenamed("author", "kept")).collect()
    assert len(got) == 13 and all(r.kept in (True, False) for r in got)
    by = {r.msg_id: r for r in got}
    assert by[2].base_failed and not by[2].kept and by[4].n_words == 0 and by[1].kept and by[None].kept
    assert quality_rules(nothing).collect() == []


@given(st.text(alphabet="ab \n", max_size=80))
@settings(max_examples=25, deadline=None)
def test_repeats(spark, text):
    r = base_metrics(spark.createDataFrame([(text,)], "text string")).first()
    assert r.n_repeat_words == metrics(text)[5]

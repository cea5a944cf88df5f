"""op7: quotes, links, order, samples; against a walk in memory."""

import random
import re

from threadloom.llm.chat import chat_samples, threaded

SCHEMA = "dataset string, conv_id string, pos long, author string, text string"


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip(" ")


def model(texts):
    """Reply order, links and own texts of one conversation, message by message."""
    own, links, quotes = [], [], []
    for text in texts:
        runs = []
        for line in text.split("\n"):
            mark = re.match(r"(?:[ \t]?>)+ ?", line)
            level = mark.group().count(">") if mark else 0
            line = line[mark.end() :] if mark else line
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        keys = [{norm(x) for p in [o, *o.split("\n\n")] for x in [p, *p.split("\n")]} - {""} for o in own]
        asked = [(lv, "\n".join(ls)) for lv, ls in runs if lv and norm("\n".join(ls))]
        quotes.append(len(asked))
        found = []
        for k, (level, passage) in enumerate(asked):
            latest = lambda x: next((i for i in range(len(own) - 1, -1, -1) if x in keys[i]), None)
            hit = latest(norm(passage))
            if hit is None:
                votes = [latest(x) for x in {norm(x) for x in passage.split("\n")} - {""}]
                votes = [v for v in votes if v is not None]
                hit = max(votes, key=lambda v: (votes.count(v), v)) if votes else None
            if hit is not None:
                found.append((level, k, hit))
        links.append(found)
        own.append("\n".join("\n".join(ls).strip(" ") for lv, ls in runs if not lv).strip(" "))
    up = [min(f)[2] if f else (i - 1 if i else None) for i, f in enumerate(links)]
    children = {}
    for i, p in enumerate(up):
        children.setdefault(p, []).append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(children.get(i, []), reverse=True)
    return own, up, order, quotes, [len(f) for f in links]


def conversation(rng, n):
    texts = []
    for i in range(n):
        lines = [f"line {rng.randrange(60)} of {i}" for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.2:
            lines.insert(1, "")
        if texts and rng.random() < 0.5:
            source = rng.choice(texts).split("\n")
            some = source[: rng.randrange(1, len(source) + 1)]
            lines = ["> " + s.upper() if rng.random() < 0.5 else ">" + s for s in some] + lines
        texts.append("\n".join(lines))
    return texts


def test_against_the_walk(spark):
    rng = random.Random(8)
    talks = {f"c{k}": conversation(rng, rng.choice([1, 2, 9, 25])) for k in range(12)}
    rows = [("d", c, i, f"u{i % 3}", t) for c, texts in talks.items() for i, t in enumerate(texts)]
    got = threaded(spark.createDataFrame(rows, SCHEMA)).collect()
    for c, texts in talks.items():
        own, up, order, quotes, links = model(texts)
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.order)
        assert [r.pos for r in mine] == order
        for r in mine:
            assert (r.own_text, r.reply_to, r.n_quotes, r.n_linked) == (own[r.pos], up[r.pos], quotes[r.pos], links[r.pos])


def test_deep_branches(spark):
    texts = ["root", "a0", "> root\nb0"] + [f"> {'root' if k == 0 else f'q{k - 1}'}\nq{k}" for k in range(20)] + ["> a0\nlast"]
    rows = [("d", "c", i, "u", t) for i, t in enumerate(texts)]
    order = model(texts)[2]
    assert [r.pos for r in threaded(spark.createDataFrame(rows, SCHEMA)).orderBy("order").collect()] == order
    parts = chat_samples(spark.createDataFrame(rows, SCHEMA), 5).orderBy("part").collect()
    assert [r.n_messages for r in parts] == [5, 5, 5, 5, 4]
    assert "\n".join(r.chat for r in parts) == "\n".join(f"<|u|>\n{model(texts)[0][i]}" for i in order)


def test_frequent_lines_meet_once(spark):
    rows = [("d", "c", i, "u", "thanks" if i % 2 else "> thanks\nok") for i in range(300)]
    got = threaded(spark.createDataFrame(rows, SCHEMA))
    assert {(r.pos, r.reply_to) for r in got.where("n_linked > 0").collect()} == {(i, i - 1) for i in range(2, 300, 2)}


def test_odd_rows(odd, nothing):
    got = chat_samples(odd.withColumnRenamed("score", "chat")).collect()
    assert sum(r.n_messages for r in got) == 13 and all(r.chat is not None for r in got)
    assert {r.conv_id for r in got} == {"c", "d", "e", None}
    assert "<|unknown|>" in next(r.chat for r in got if r.conv_id is None)
    assert chat_samples(nothing).collect() == []

"""op12: spans against the plain patterns, added kinds, odd rows."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.personal import ADDED, BASE, find_personal_data, luhn, spans_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    n = sum(c in "0123456789" for c in s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= n <= 19 and luhn(re.sub("[^0-9]", "", s))
    return kind == "email" or 9 <= n <= 15


def brute(text):
    found = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(PATTERNS[k], text) if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def base(text):
    return [s for s in spans_of(text) if s[0] in BASE]


def test_luhn():
    assert luhn("4539148803436467") and not luhn("4539148803436468")


@given(st.text(alphabet="ab1.2@@+- ()9é%", max_size=60))
@settings(max_examples=800, deadline=None)
def test_patterns(text):
    assert base(text) == brute(text)


@given(st.integers(0, 10**9))
@settings(max_examples=400, deadline=None)
def test_numbers(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randrange(1, 12)):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 21)))
        check = next(d for d in "0123456789" if luhn(digits + d))
        spread = "".join(c + rng.choice(["", "", "", " ", "-"]) for c in digits + check)
        address = ".".join(str(rng.randrange(300)) for _ in range(rng.randrange(2, 10)))
        number = "+" + rng.choice(["1 (", "49-", "7."]) + digits[:12] + rng.choice([")", "", " ("])
        parts.append(rng.choice([spread, digits + check, address, number, f"x.{digits}@a-b.c{digits[:2]}.", "@", "\U0001f600 ü "]))
    text = rng.choice([" ", "", "\n", "."]).join(parts)
    assert base(text) == brute(text)


def test_added_kinds():
    text = "ask <@Bob B> or <@bob>, see https://x.example.org/a?b=1, Konto Nr. 1234 5678 90; IBAN: DE89 3704 0044 0532 0130 00. SSN 123-45-6789, accounting 123456789"
    got = {k: text[a:b] for k, a, b in spans_of(text) if k in ADDED}
    assert got == {
        "mention": "<@bob>",
        "url": "https://x.example.org/a?b=1",
        "account": "1234 5678 90",
        "iban": "DE89 3704 0044 0532 0130 00",
        "identity": "123-45-6789",
    }


def test_long_texts_of_anchors():
    for piece in ("1", "1.", "@", "a@", "+1", "1 ", "://", "iban ", "a://", "9.9.9."):
        text = piece * (400_000 // len(piece))
        assert len(spans_of(text)) <= len(text)


def test_rows(spark, odd, nothing):
    rows = [("c1", 0, "mail bob@x.org, call +1 (555) 123-4567", "s"), ("c1", 0, "mail bob@x.org, call +1 (555) 123-4567", "s"), ("c2", 1, None, None), ("c2", None, "", "t")]
    msgs = spark.createDataFrame(rows, "conv_id string, pos int, text string, spans string")
    got = sorted(find_personal_data(msgs).collect(), key=str)
    assert len(got) == 4
    twice = [r for r in got if r.conv_id == "c1"]
    assert all(r.redacted_text == "mail <email>, call <phone>" and [s.kind for s in r.spans] == ["email", "phone"] for r in twice)
    assert {(r.text, r.redacted_text) for r in got if r.conv_id == "c2"} == {(None, None), ("", "")} and not any(r.spans for r in got if r.conv_id == "c2")
    for r in find_personal_data(odd).collect():
        assert [tuple(s) for s in r.spans if s.kind in BASE] == (brute(r.text) if r.text else [])
    assert find_personal_data(nothing).count() == 0
    assert find_personal_data(odd).columns == [*odd.columns, "spans", "redacted_text"]


def test_event_messages(spark, sf):
    from threadloom.sources.events import event_messages

    found = find_personal_data(event_messages(spark, sf).select("dataset", "conv_id", "pos", "author", "text"))
    rows = found.collect()
    assert rows and all([s.kind for s in r.spans] == ["mention"] * len(re.findall(r"<@[^>]+>", r.text)) for r in rows)


def test_query(spark, sf):
    import hashlib

    from threadloom.llm.queries import op12

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()

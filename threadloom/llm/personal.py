"""Personal data in messages: anchors found by one automaton, spans grown from them by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from threadloom.llm.ragged import chunks

#: Kinds with fixed patterns, in the order that breaks ties of place.
BASE = ("email", "ip", "card", "phone")
#: Kinds that only anchors lead to.
ADDED = ("mention", "url", "iban", "account", "identity")
KINDS = (*BASE, *ADDED)

#: Words that announce an identifier, each as written, capitalised and in capitals.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "identity": ("ssn", "social security", "passport", "reisepass", "pasaporte", "passeport"),
}

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
ADDRESS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"|\\^`{}]*)?")
NAME = re.compile(r"[^\s<>@]{1,80}>")
FILLER = re.compile(r"(?:[\x20.:#=-]|(?i:number|nummer|num|nr|no|is|n°|numero|número)(?![A-Za-z])){0,8}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[A-Z0-9](?:[\x20-]?[A-Z0-9]){5,33}(?![A-Za-z0-9])")
IDENTITY = re.compile(r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{0,2}[0-9]{6,9}[A-Z]?)(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    back = [int(d) for d in reversed(digits)]
    return sum(back[::2] + [2 * d - 9 * (d > 4) for d in back[1::2]]) % 10 == 0


def iban_ok(text: str) -> bool:
    """The remainder that account numbers of this form have."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors: at-sign, plus, digits, schemes and cues; each knows its kind and its length."""
    found = ahocorasick.Automaton()
    anchors = [("@", "@"), ("+", "+"), ("://", "url"), *((d, "digit") for d in "0123456789")]
    anchors += [(form, kind) for kind, words in CUES.items() for w in words for form in {w, w.capitalize(), w.title(), w.upper()}]
    for word, kind in anchors:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data in one text, by start, then kind, then end.

    Every character is grown over a constant number of times: a kind continues after its last try,
    so long texts of anchors cost no more than their length.
    """
    out: list[tuple[str, int, int]] = []
    # where the next span of a kind may start
    email, ip, card, url, cued = 0, 0, 0, 0, 0
    for last, (kind, size) in automaton().iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and 12 <= m.end() - at <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, m.end()))
            if at >= ip:
                m = IP.match(text, at)
                ip = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    out.append(("ip", at, ip))
        elif kind == "@":
            m = DOMAIN.match(text, last + 1)
            if m:
                start = at
                while start > email and text[start - 1] in LOCAL_PART:
                    start -= 1
                if start < at:
                    email = m.end()
                    out.append(("email", start, email))
            if at and text[at - 1] == "<" and (m := NAME.match(text, last + 1)):
                out.append(("mention", at - 1, m.end()))
        elif kind == "+":
            m = PHONE.match(text, at)
            if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at, m.end()))
        elif kind == "url":
            start = at
            while start > url and at - start < 20 and text[start - 1] in SCHEME:
                start -= 1
            m = ADDRESS.match(text, last + 1)
            if m and start < at and text[start].isalpha():
                url = last + 1 + len(m[0].rstrip(".,;:!?)]'*_"))
                out.append(("url", start, url))
        elif at >= cued and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
            m = FILLER.match(text, last + 1)
            grown = {"iban": IBAN, "account": ACCOUNT, "identity": IDENTITY}[kind].match(text, m.end())
            if grown and (iban_ok(grown[0]) if kind == "iban" else sum(c.isdigit() for c in grown[0]) >= 6):
                cued = grown.end()
                out.append((kind, grown.start(), cued))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one."""
    parts, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find_personal_data(messages: DataFrame) -> DataFrame:
    """Add ``spans`` and ``redacted_text`` to messages(text, ...).

    ``spans`` is an array of (kind, start, end): characters (code points) from ``start`` up to ``end``,
    by start, then kind in the order of KINDS.  One Aho-Corasick pass finds the anchors: at-signs,
    plus signs, digits, scheme separators and words that announce an identifier; a parser for each
    grows and checks the span around it.  The kinds of BASE are exactly the leftmost, non-overlapping
    matches of their patterns that pass their check (parts up to 255, Luhn, number of digits).  ADDED:
    chat mentions ``<@name>``, addresses with a scheme, and account and identity numbers after a cue.
    ``redacted_text`` has spans replaced by their kind.

    A narrow pass: no exchange, memory of one text and its spans.  Null or empty text: no span, the
    text as it is.  Repeated rows are searched one by one, ids are not used, an empty table gives an
    empty one; columns of the names of the results are replaced.
    """
    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
    new = [StructField("spans", kind), StructField("redacted_text", StringType())]
    rows = messages.drop(*[f.name for f in new])
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            texts = t["text"].to_pylist()
            spans = [spans_of(x) if x else [] for x in texts]
            clean = [redacted(x, s) if s else x for x, s in zip(texts, spans, strict=True)]
            cells = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield from t.select(names).append_column("spans", pa.array(cells, shape)).append_column("redacted_text", pa.array(clean, pa.string())).to_batches()

    return rows.mapInArrow(work, StructType([*rows.schema.fields, *new]))

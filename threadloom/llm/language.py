"""Language of messages: mixtures of languages by expectation-maximisation over n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from threadloom.llm.letters import END, letters_only, texts_of
from threadloom.llm.ragged import chunks, mix, rolling

#: Letters of a gram and bits of its bucket; a model has languages x 2^BITS numbers.
GRAM = 3
BITS = 16
#: Labels a model may have; it is broadcast, so this bounds its size.
MAX_LANGS = 512
#: Grams of a segment, the unit that the mixture gives to one language.
SEGMENT = 24
ROUNDS = 12
#: Numbers (segments x languages) and characters of text that a task works on at a time; one text is never split.
CELLS = 1 << 22
GROUP_CHARS = 1 << 20
#: Pseudo-observations of the pooled distribution in each language.
PRIOR = 2000.0
#: Weight of a further language, in units of log(segments).
PENALTY = 2.0

UNKNOWN = "und"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every gram of letters and single blanks that holds a letter."""
    codes = letters_only(texts)
    if len(codes) < GRAM:
        codes = np.append(codes, np.zeros(GRAM, np.uint32))
    row = texts_of(codes)
    bucket = mix(rolling(codes.astype(np.uint64), GRAM)) >> np.uint64(64 - BITS)
    n = len(bucket)
    end = codes == END
    ok = ~(end[:n] | end[1 : n + 1] | end[2 : n + 2])
    return row[:n][ok], bucket[ok].astype(np.int64)


def gram_counts(messages: DataFrame) -> DataFrame:
    """(lang, gram, n) over all messages with a label; a task adds up its rows first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for t in chunks(batches):
            langs = t["lang"].to_pylist()
            row, bucket = grams(t["text"].to_pylist())
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            seen = np.bincount(code[row] << BITS | bucket, minlength=len(names) << BITS).reshape(len(names), -1)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + seen[k]
        for name, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], ["lang", "gram", "n"])

    found = messages.where("lang is not null and text is not null").select("lang", "text").mapInArrow(work, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_model(messages: DataFrame) -> dict:
    """Languages and log probabilities of their grams, from all labelled messages."""
    rows = gram_counts(messages).toPandas()  # at most languages x 2^BITS rows
    langs = sorted(rows["lang"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} labels; a model has at most {MAX_LANGS}")
    n = np.zeros((len(langs), 1 << BITS))
    n[np.searchsorted(langs, rows["lang"].to_numpy(str)) if langs else [], rows["gram"].to_numpy(np.int64)] = rows["n"]
    pooled = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * (1 << BITS))
    return {"langs": langs, "log": np.log((n + PRIOR * pooled) / (n.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32).T.copy()}


def _fit(log: np.ndarray, row: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages, and the log likelihood, of each text."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    top = np.where(allowed[row], log, -np.inf).max(axis=1, keepdims=True)
    like = np.where(allowed[row], np.exp(log - top), 0.0)
    n = np.diff(np.append(start, len(row)))[:, None]
    for _ in range(ROUNDS):
        part = share[row] * like
        part /= part.sum(axis=1, keepdims=True)
        share = np.where(allowed, np.maximum(np.add.reduceat(part, start, axis=0) / n, 1e-12), 0.0)
    total = np.log((share[row] * like).sum(axis=1)) + top[:, 0]
    return share, np.add.reduceat(total, start)


def segment_sums(log: np.ndarray, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log likelihood of each segment (one column a language), gathered over about CELLS numbers at a time."""
    out = np.empty((len(start), log.shape[1]))
    many = max(1, CELLS // (SEGMENT * log.shape[1]))
    for a in range(0, len(start), many):
        stop = start[a + many] if a + many < len(start) else len(bucket)
        out[a : a + many] = np.add.reduceat(log[bucket[start[a] : stop]], start[a : a + many] - start[a], axis=0)
    return out


def grouped(texts: list[str | None], wide: int) -> Iterator[list[str | None]]:
    """Texts in order, so many at a time that their segments have about CELLS numbers for ``wide`` languages."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size * max(wide, 1) >= CELLS * SEGMENT or size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def mixtures(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of all languages before, and of the selected ones after, selection (one row a text).

    Language sets are nested: the languages of a text in the order of their share in the full
    mixture.  A set may grow while log likelihood - PENALTY * languages * log(segments) does.
    """
    wide = len(model["langs"])
    full, chosen = np.zeros((len(texts), wide)), np.zeros((len(texts), wide))
    row, bucket = grams(texts)
    if not len(row) or not wide:
        return full, chosen
    first = np.searchsorted(row, row)
    seg = (np.arange(len(row)) - first) // SEGMENT
    s = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])))
    log = segment_sums(model["log"], bucket, s)
    text = row[s]
    start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    ids, at = text[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(text))))
    share, _ = _fit(log, at, start, np.ones((len(ids), wide), bool))
    full[ids] = share
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    cost = PENALTY * np.log(np.diff(np.append(start, len(text))) + 1.0)
    best, value = np.zeros((len(ids), wide)), np.full(len(ids), -np.inf)
    open_ = np.ones(len(ids), bool)
    for size in range(1, wide + 1):
        mixed, fit = _fit(log, at, start, rank < size)
        better = open_ & (fit - cost * size > value)
        best[better], value[better] = mixed[better], (fit - cost * size)[better]
        open_ = better
        if not open_.any():
            break
    chosen[ids] = best
    return full, chosen


def identify_languages(messages: DataFrame, model: dict) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``lang_mix`` to messages, from ``text`` alone.

    messages(text, ...); ``model`` comes from :func:`language_model`.  A text is cut into segments
    of letter n-grams; expectation-maximisation gives the share of each language among them, and the
    language set is the one of best penalised likelihood.  ``lang_pred`` has the largest selected
    share (ties: the label that sorts first), ``score`` is its share in the mixture of all
    languages, ``lang_mix`` an array of (lang, share) of the selected set.

    Null text or no letter, or an empty model: ``und``, score 0, empty mix.  Every row is judged
    on its own; an empty table gives an empty result.
    """
    kind = ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())]))
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_mix", kind)]
    rows = messages.drop(*[f.name for f in new])
    names, shared = rows.columns, messages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model["langs"]
        for t in chunks(batches):
            texts = t["text"].to_pylist()
            parts = [mixtures(some, model) for some in grouped(texts, len(langs))]
            full, chosen = (np.concatenate(x) for x in zip(*parts, strict=True))
            pred, score, mixed = [], [], []
            for text, f, c in zip(texts, full, chosen, strict=True):
                if not len(c) or not c.any():
                    known = bool(langs) and bool(text) and any(map(str.isalpha, text))
                    pred.append(langs[0] if known else UNKNOWN)  # letters, but no gram of them
                    score.append(1.0 / len(langs) if known else 0.0)
                    mixed.append([])
                    continue
                k = int(np.argmax(c))
                pred.append(langs[k])
                score.append(min(1.0, float(f[k])))
                mixed.append([{"lang": langs[i], "share": float(c[i])} for i in np.argsort(-c, kind="stable") if c[i] > 0])
            out = t.select(names).append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(score, pa.float64()))
            shape = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield from out.append_column("lang_mix", pa.array(mixed, shape)).to_batches()

    return rows.mapInArrow(work, StructType([*rows.schema.fields, *new]))

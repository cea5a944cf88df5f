"""Toxic passages of messages: maximum-scoring segments of word log-odds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from threadloom.llm.ragged import chunks, flat, split_words
from threadloom.session import materialize

#: Bits of a word's bucket; a model has 2^BITS numbers whatever the corpus.
BITS = 18
#: Labelled messages the classifier is fitted on at most (the ones whose ids hash lowest).
SAMPLE = 20_000
#: Every so many of them calibrate; the others give the log-odds.
CALIBRATE = 4
#: Words' weight of the corpus-wide distribution as prior of both classes.
PRIOR = 2000.0
#: Standard errors by which a log-odds must exceed 0 to count.
SURE = 2.0
#: Cost of a word that is no evidence.
LEAST_COST = 0.05
#: Passages are significant below this chance.
CHANCE = 0.05
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

_OTHER = ~((np.arange(256) >= 128) | np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_buckets(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word: a run of letters, A-Z as a-z (bytes above 127 count as letters)."""
    raw, off = flat(texts)
    lower = _LOWER[raw]
    w = split_words(np.where(_OTHER[lower], np.uint8(32), lower), off)
    return w.text_of(), (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)


def sample_labels(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled ids (msg_id, toxic, calibrates); an id with several labels is toxic if one is."""
    one = labels.where("msg_id is not null and toxic is not null").groupBy("msg_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("msg_id")
    picked = one.orderBy(order, "msg_id").limit(size)
    return materialize(picked.select("msg_id", "toxic", (F.pmod(F.xxhash64("msg_id", F.lit(1)), F.lit(CALIBRATE)) == 0).alias("calibrates")), "labels")


def word_counts(messages: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, every, toxic, clean): messages that hold a word of the bucket.

    ``every`` counts all messages; a task adds up its rows first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.int64)
        for t in chunks(batches):
            row, bucket = word_buckets(t["text"])
            seen = np.unique(row << BITS | bucket)
            row, bucket = seen >> BITS, seen & ((1 << BITS) - 1)
            label = t["label"].to_numpy(zero_copy_only=False)[row]
            total[0] += np.bincount(bucket, minlength=1 << BITS)
            for k, value in ((1, 1), (2, 0)):
                total[k] += np.bincount(bucket[label == value], minlength=1 << BITS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], ["bucket", "every", "toxic", "clean"])

    known = sample.where("not calibrates").select("msg_id", F.col("toxic").alias("label"))
    rows = messages.select("msg_id", "text").join(F.broadcast(known), "msg_id", "left")  # at most SAMPLE rows
    found = rows.select("text", F.coalesce("label", F.lit(-1)).alias("label")).mapInArrow(work, "bucket bigint, every bigint, toxic bigint, clean bigint")
    return found.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in ("every", "toxic", "clean")])


def word_scores(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Score of each bucket, and the cost of a word without one.

    Log-odds of toxic against clean messages with a Dirichlet prior in proportion to the whole
    corpus, less SURE standard errors; what is left above 0 is evidence.  The cost makes the mean
    score of a clean message's words negative, so segments end.
    """
    every, toxic, clean = counts.astype(float)
    prior = PRIOR * (every + 1e-3) / (every + 1e-3).sum()
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    sure = odds - SURE * np.sqrt(1 / a + 1 / b)
    score = np.where((sure > 0) & (toxic > 0), sure, 0.0)
    return score, max(LEAST_COST, 2 * float((score * b).sum() / b.sum()))


def segments(place: np.ndarray, score: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of one message, in one pass.

    ``place`` and ``score`` are its words with evidence; the words between them cost ``cost`` each.
    """
    out: list[list[float]] = []  # first, end, sum before, sum after
    at, total = 0, 0.0
    for p, s in zip(place.tolist(), score.tolist(), strict=True):
        total -= cost * (p - at)
        at = p + 1
        left, right, start = total, total + s, p
        total = right
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = int(out[j][4])
            if j < 0 or out[j][3] >= right:
                out.append([start, at, left, right, j])
                break
            start, left = int(out[j][0]), out[j][2]
            del out[j:]
    return [(int(a), int(b), r - le) for a, b, le, r, _ in out]


def scanned(texts: pa.ChunkedArray, score: np.ndarray, cost: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of words and the segments of each text."""
    row, bucket = word_buckets(texts)
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    s = score[bucket]
    hit = np.flatnonzero(s > 0)
    ends = np.searchsorted(row[hit], np.arange(len(texts)), side="right")
    begin = np.append(0, ends[:-1])
    for k in range(len(texts)):
        mine = hit[begin[k] : ends[k]]
        yield int(n[k]), segments(mine - first[k], s[mine], cost) if len(mine) else []


def features(n: np.ndarray, count: np.ndarray, total: np.ndarray, best: np.ndarray, tail: tuple[float, float]) -> np.ndarray:
    """What the final score is made of: surprise at the best segment, and the evidence of all."""
    rate, scale = tail
    surprise = np.where(count > 0, scale * best - np.log(rate * np.maximum(n, 1)), 0.0)
    return np.stack([np.ones(len(n)), np.clip(surprise, -5, 30) / 10, np.log1p(total), (count > 0).astype(float)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    if not 0 < y.sum() < len(y):  # nothing to tell apart: the share of toxic ones, drawn to one in twenty
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 19))
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
        w = w + np.linalg.solve(h, x.T @ (y - p) - np.append(0.0, w[1:]))
    return w


def toxicity_model(messages: DataFrame, labels: DataFrame, size: int = SAMPLE) -> dict:
    """Word scores, tail of clean segments, and calibration.

    messages(msg_id, text), labels(msg_id, toxic 0/1).  The prior counts every message; labels come
    from at most ``size`` labelled messages, a part of which only calibrates.  Segments of clean
    calibration messages give the extreme-value tail: a message of n words is expected to hold
    rate * n * exp(-scale * s) segments that score s or more.  If the calibrating messages are not of
    both classes (or there are none), every text gets the same score: the share of toxic ones with a
    prior of one in twenty, so nothing is predicted toxic without labels.
    """
    sample = sample_labels(labels, size)
    counts = np.zeros((3, 1 << BITS), np.int64)
    rows = word_counts(messages, sample).toPandas()  # at most 2^BITS rows
    counts[:, rows["bucket"].to_numpy(np.int64)] = rows[["every", "toxic", "clean"]].to_numpy(np.int64).T
    score, cost = word_scores(counts)
    shared = messages.sparkSession.sparkContext.broadcast(score)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            got = [(n, len(s), sum(x[2] for x in s), max((x[2] for x in s), default=0.0)) for n, s in scanned(t["text"], shared.value, cost)]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([t["toxic"].combine_chunks(), *cols], ["toxic", "n", "count", "total", "best"])

    held = messages.select("msg_id", "text").join(F.broadcast(sample.where("calibrates")), "msg_id").select("toxic", "text")
    seen = held.mapInArrow(work, "toxic int, n bigint, count bigint, total double, best double").toPandas()  # at most SAMPLE ids
    clean = seen[seen["toxic"] == 0]
    tail = ((clean["count"].sum() + 1) / (clean["n"].sum() + 1e3), (clean["count"].sum() + 1) / (clean["total"].sum() + 1))
    x = features(*(seen[k].to_numpy() for k in ("n", "count", "total", "best")), tail)
    return {"score": score, "cost": cost, "tail": tail, "weights": _logistic(x, seen["toxic"].to_numpy(float))}


def score_toxicity(messages: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (INT, 1 from ``threshold`` on) and ``passages``, from ``text`` alone.

    messages(text, ...); ``model`` comes from :func:`toxicity_model` and has a fixed size, so it is
    broadcast.  One pass over a message's words finds all maximal scoring segments; those whose
    expected number by chance is below CHANCE are its ``passages``: (first word, end, score, chance).
    The score is calibrated from the chance of the best segment and the evidence of all.

    Null or empty text: no passage and the score of a message without evidence.  Every row is scored
    on its own; an empty table gives an empty result.
    """
    kind = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("score", DoubleType()), StructField("chance", DoubleType())]))
    new = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("passages", kind)]
    rows = messages.drop(*[f.name for f in new])
    names, shared = rows.columns, messages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rate, scale = m["tail"]
        for t in chunks(batches):
            size, passages, stats = [], [], []
            for n, found in scanned(t["text"], m["score"], m["cost"]):
                size.append(n)
                stats.append((len(found), sum(s for *_, s in found), max((s for *_, s in found), default=0.0)))
                chance = [-np.expm1(-rate * n * np.exp(-scale * s)) for *_, s in found]
                passages.append([{"start": a, "stop": b, "score": s, "chance": float(c)} for (a, b, s), c in zip(found, chance, strict=True) if c < CHANCE])
            x = features(np.array(size), *np.array(stats, float).reshape(-1, 3).T, m["tail"])
            score = 1 / (1 + np.exp(-np.clip(x @ m["weights"], -30, 30)))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
            out = t.select(names).append_column("score", pa.array(score, pa.float64())).append_column("predicted", pa.array((score >= threshold).astype(np.int32)))
            yield from out.append_column("passages", pa.array(passages, shape)).to_batches()

    return rows.mapInArrow(work, StructType([*rows.schema.fields, *new]))

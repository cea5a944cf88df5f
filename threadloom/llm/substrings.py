"""Repeated passages of messages, by super-k-mers of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadloom.llm.ragged import BLANK, chunks, flat, mix, ranges, rolling, runs, split_words
from threadloom.llm.slices import Slices, buckets_for, deal, in_pieces, later_windows, merged, minimiser_runs, placed, settle, spans_of, unpacked, with_spans

#: Words of a window and of the minimiser that deals it.
WINDOW = 20
MINIMISER = 4


def drop_repeated_passages(messages: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    messages(msg_id, text, ...) -> the same columns and ``n_words``, ``n_removed`` (BIGINT),
    ``kept_text`` (the kept words joined by one blank).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, compared byte by byte.  Earlier: smaller key
    (``dataset, conv_id, pos`` where the messages have them, else ``msg_id``, of any type; nulls
    first), or the same message and an earlier word; windows are judged on the input.  Consecutive windows
    with one minimiser form a super-k-mer that goes to the minimiser's bucket as one packed string;
    the bucket sorts the windows and compares the equal ones byte by byte.  Windows of a minimiser
    that is too common for one bucket are dealt one by one and compared by 128-bit digests.

    Null or empty text: no words, ``kept_text`` is empty.  Rows that repeat a key are ordered by a
    hash of their text; rows of one key and one text stand at the same place and do not remove each
    other's words where they start at the same word.  An empty table gives an empty result.
    """
    rows = placed(messages.drop("n_words", "n_removed", "kept_text"))
    parts = buckets_for(rows)
    cut = in_pieces(lambda raw, off: super_kmers(raw, off, window, minimiser), lambda text, size: word_pieces(text, size, window))
    dealt = deal(rows, cut, window, parts, lambda s: single_windows(s, window))
    return _keep(with_spans(rows, settle(dealt, lambda text, place: _windows(text, place, window), window, parts)))


def super_kmers(raw: np.ndarray, off: np.ndarray, window: int, minimiser: int) -> Slices:
    w = split_words(raw, off)
    valid = _starts(w.first, window)
    if not len(valid):
        return Slices([], *(np.zeros(0, np.int64),) * 5)
    grams = rolling(w.hashes(), minimiser)
    at, n, low, multi = minimiser_runs(grams, window - minimiser + 1, valid)
    row = np.searchsorted(w.first, at, side="right") - 1
    data = w.data.tobytes()
    text = [data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at + n + window - 2].tolist(), strict=True)]
    return Slices(text, row, at - w.first[row], n, low, multi)


def word_pieces(text: np.ndarray, size: int, window: int) -> list[tuple[int, int, int]]:
    """(first word, first byte, end) of pieces of about ``size`` bytes that overlap by ``window - 1`` words."""
    inside = np.concatenate([[False], ~BLANK[text], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    first = np.unique(np.searchsorted(start, np.arange(0, len(text), size)))
    first = first[first <= len(start) - window]
    stop = np.append(first, len(start))[1:]
    return [(a, int(start[a]), int(end[min(b + window - 2, len(end) - 1)])) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def single_windows(piece: bytes, window: int) -> list[bytes]:
    words = piece.split(b" ")
    return [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]


def _starts(first: np.ndarray, window: int) -> np.ndarray:
    """Words at which a window of one text starts."""
    return ranges(first[:-1], np.maximum(np.diff(first) - window + 1, 0))


def _windows(text: list[bytes], place: dict, window: int) -> dict:
    """Sort the windows of a bucket's slices and return the spans of later equal ones."""
    off = np.concatenate([[0], np.cumsum([len(s) for s in text])])
    w = split_words(np.frombuffer(b"".join(text), np.uint8), off)
    valid = _starts(w.first, window)
    key = mix(rolling(w.hashes(), window))[valid]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = order[np.append(same, False) | np.append(False, same)]
    valid, key = valid[twice], key[twice]
    row = np.searchsorted(w.first, valid, side="right") - 1
    start = place["start"][row] + valid - w.first[row]
    group = _exact(w, valid, key, window)
    later, _ = later_windows(group, place["at"][row], start)
    return merged(row[later], start[later], place, window)


def _exact(w, valid: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Group number of each window; windows of one hash that differ in a byte get different ones."""
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    head = valid[first[group]]
    order = np.argsort(valid)
    a, f = valid[order], head[order]
    if not len(a):
        return group
    # windows that follow each other in both slices are compared as one string
    s, n = runs(np.concatenate([[True], (a[1:] != a[:-1] + 1) | (f[1:] != f[:-1] + 1)]))
    data = memoryview(w.data)
    ends = w.end
    for k, c in zip(s.tolist(), n.tolist(), strict=True):
        if a[k] == f[k]:
            continue
        x, y = (data[w.start[v[k]] : ends[v[k] + c + window - 2]] for v in (a, f))
        if x != y:
            for i in range(k, k + c):
                x, y = (bytes(data[w.start[v[i]] : ends[v[i] + window - 1]]) for v in (a, f))
                if x != y:  # two strings with one hash: split that hash by content
                    return _by_content(w, valid, window)
    return group


def _by_content(w, valid: np.ndarray, window: int) -> np.ndarray:
    names: dict[bytes, int] = {}
    data = w.data.tobytes()
    return np.array([names.setdefault(data[w.start[v] : w.end[v + window - 1]], len(names)) for v in valid.tolist()], np.int64)


def _keep(rows: DataFrame) -> DataFrame:
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    schema = StructType([*rows.schema["row"].dataType.fields, *new])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            w = split_words(*flat(t["text"]))
            data, total = w.data.tobytes(), np.diff(w.first)
            gone, kept = [], []
            for a, b, spans in zip(w.first[:-1].tolist(), w.first[1:].tolist(), spans_of(t["spans"]), strict=True):
                at, pieces = a, []
                for x, y in [*((a + x, a + y) for x, y in spans), (b, b)]:
                    if x > at:
                        pieces.append(data[w.start[at] : w.end[x - 1]])
                    at = y
                gone.append(sum(y - x for x, y in spans))
                kept.append(b" ".join(pieces).decode())
            out = unpacked(t["row"]).append_column("n_words", pa.array(total, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64()))
            yield from out.append_column("kept_text", pa.array(kept, pa.string())).to_batches()

    return rows.mapInArrow(work, schema)

"""Messages that contain passages of a benchmark, found by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from threadloom.llm.letters import END, blanks_squeezed, texts_of
from threadloom.llm.ragged import chunks, mix, ranges, rolling, runs

#: Characters of a q-gram.
Q = 12
#: Characters of a passage and the step between the passages of an item.
PASSAGE = 50
STEP = 1
#: Edits a passage may have, in hundredths of its length.
EDITS = 7
#: Of candidate passages that follow each other, one in so many is aligned first; the others only if none of those matches.
AHEAD = 16
#: Characters of benchmark text that are broadcast at a time; a larger benchmark takes several passes.
PIECE_CHARS = 4_000_000

_FILTER_BITS = 22


def passages(items: list[tuple[int, str]]) -> dict:
    """The passages of the items, and the q-grams of the items sorted by hash.

    A passage of m characters with k edits shares at least m - Q + 1 - k * Q q-grams with its match.
    Items stand in ``codes`` one after another; a passage is a stretch of them (``first``, ``size``).
    """
    codes = [blanks_squeezed([text])[1:-2] if (text or "").strip() else np.zeros(0, np.uint32) for _, text in items]
    length = np.array([len(c) for c in codes], np.int64)
    base = np.cumsum(length) - length
    count = np.where(length > 0, np.maximum(length - PASSAGE, 0) // STEP + 1, 0)
    of = np.repeat(np.arange(len(items)), count)
    size = np.minimum(length, PASSAGE)[of]
    edits = size * EDITS // 100
    need = size - Q + 1 - edits * Q
    edits = np.where(need < 1, np.maximum(size - Q, 0) // Q, edits)
    flat = np.concatenate([*codes, np.zeros(Q, np.uint32)]).astype(np.uint32)
    n = np.maximum(length - Q + 1, 0)
    at = ranges(base, n)
    key = mix(rolling(flat.astype(np.uint64), Q))[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[key >> np.uint64(64 - _FILTER_BITS)] = True
    owner = np.repeat(np.arange(len(items)), n)
    return {
        "item": np.array([k for k, _ in items], np.int64)[of], "codes": flat, "first": base[of] + STEP * ranges(np.zeros(len(items), np.int64), count),
        "size": size.astype(np.int16), "edits": edits.astype(np.int16), "need": (size - Q + 1 - edits * Q).astype(np.int16),
        "length": length, "passages": np.cumsum(count) - count, "count": count,
        "key": key[order], "owner": owner[order].astype(np.int32), "offset": (at - base[owner])[order].astype(np.int32), "seen": seen,
    }


def hits(codes: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item number, offset in the item) of every q-gram that the texts share with an item."""
    none = np.zeros(0, np.int64)
    if len(codes) < Q or not len(index["key"]):
        return none, none, none
    key = mix(rolling(codes.astype(np.uint64), Q))
    at = np.flatnonzero(index["seen"][key >> np.uint64(64 - _FILTER_BITS)])
    lo = np.searchsorted(index["key"], key[at])
    hi = np.searchsorted(index["key"], key[at], side="right")
    n = hi - lo
    where = ranges(lo, n)
    return np.repeat(at, n), index["owner"][where].astype(np.int64), index["offset"][where].astype(np.int64)


def regions(codes: np.ndarray, index: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first diagonal, band) of every passage that shares enough q-grams with a band.

    Bands of 2 * ``width`` diagonals of an item start every ``width``; a match of fewer than
    ``width`` edits keeps to one of them.  Texts follow each other, so a diagonal also tells the
    text.  Passages of one item on one band follow each other.
    """
    place, item, offset = hits(codes, index)
    shift = width * (int(index["length"].max(initial=0)) // width + 2)
    band = (place - offset + shift) // width
    key, offset = np.concatenate([item << 40 | band, item << 40 | (band - 1)]), np.concatenate([offset, offset])
    _, group, n = np.unique(key, return_inverse=True, return_counts=True)
    least = index["need"][np.minimum(index["passages"][key >> 40], max(len(index["need"]) - 1, 0))] if len(key) else n[group]
    enough = n[group] >= least
    key, offset = key[enough], offset[enough]
    order = np.lexsort([offset, key])
    key, offset = key[order], offset[order]
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    s, n = runs(np.append(True, key[1:] != key[:-1]))
    item = key[s] >> 40
    reach = np.minimum(index["length"][item], PASSAGE) - Q
    lo = np.maximum(-(-(offset[s] - reach) // STEP), 0)
    hi = np.minimum(offset[s + n - 1] // STEP, index["count"][item] - 1)
    many = np.maximum(hi - lo + 1, 0)
    g = np.repeat(np.arange(len(s)), many)
    k = ranges(lo, many)
    far = int(index["length"].max()) + 2 * PASSAGE
    sorted_hits = np.repeat(np.arange(len(s)), n) * far + offset
    begin = g * far + k * STEP
    passage = index["passages"][item[g]] + k
    shared = np.searchsorted(sorted_hits, begin + reach[g], side="right") - np.searchsorted(sorted_hits, begin)
    enough = shared >= index["need"][passage]
    g, k, passage = g[enough], k[enough], passage[enough]
    return passage, (key[s[g]] & ((1 << 40) - 1)) * width - shift + k * STEP, g


def align(codes: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, index: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each passage on the 2 * ``width`` diagonals from ``diagonal`` on, and the end of that match.

    The match may start and end at any diagonal of the band.
    """
    wide = 2 * width
    text = np.concatenate([np.zeros(PASSAGE + wide, np.uint32), codes, np.zeros(PASSAGE + 2 * wide, np.uint32)])
    base = diagonal + PASSAGE + wide
    size, first = index["size"][passage], index["first"][passage]
    step = np.arange(wide)
    row = np.zeros((len(passage), wide), np.int32)
    best, end = np.full(len(passage), 1 << 20, np.int64), np.zeros(len(passage), np.int64)
    for i in range(int(size.max(initial=0))):
        live = i < size
        t, ahead = (text[base[:, None] + i + k + step] for k in (0, 1))
        # passing an END costs more than any budget, so no match crosses texts
        cost = (t != index["codes"][np.minimum(first + i, len(index["codes"]) - 1)][:, None].astype(np.uint32)) + (t == END) * (1 << 12)
        pass_over = 1 + (ahead == END) * (1 << 12)
        along = np.cumsum(pass_over, axis=1) - pass_over
        skip = np.append(row[:, 1:], np.full((len(row), 1), 1 << 20, np.int32), axis=1) + 1
        nxt = np.minimum(row + cost, skip)
        nxt = np.minimum.accumulate(nxt - along, axis=1) + along
        row = np.where(live[:, None], nxt, row).astype(np.int32)
    if len(passage):
        at = row.argmin(axis=1)
        best, end = row[np.arange(len(row)), at].astype(np.int64), diagonal + size + at
    return best, end


def matched(texts: list[str | None], index: dict) -> list[list[dict]]:
    """For each text its matches (item_id, edits, start, stop): one for each item and place."""
    codes = blanks_squeezed(texts)
    out: list[list[dict]] = [[] for _ in texts]
    width = int(index["edits"].max(initial=0)) + 1
    passage, diagonal, band = regions(codes, index, width)
    if not len(passage):
        return out
    text = texts_of(codes)
    begin = np.searchsorted(text, np.arange(len(texts)))
    # passages that follow each other on one band and in one text; the place in the middle tells the text
    middle = text[np.clip(diagonal + width + index["size"][passage] // 2, 0, len(text) - 1)]
    s, n = runs(np.append(True, (band[1:] != band[:-1]) | (passage[1:] != passage[:-1] + 1) | (middle[1:] != middle[:-1])))
    run = np.repeat(np.arange(len(s)), n)
    ahead = (np.arange(len(passage)) - s[run]) % AHEAD == 0
    ok = _aligned(codes, passage[ahead], diagonal[ahead], index, width)
    done = np.zeros(len(s), bool)
    done[run[ahead][ok[0]]] = True
    rest = ~ahead & ~done[run]
    more = _aligned(codes, passage[rest], diagonal[rest], index, width)
    p = np.concatenate([passage[ahead][ok[0]], passage[rest][more[0]]])
    edits, end = (np.concatenate([x, y]) for x, y in zip(ok[1:], more[1:], strict=True))
    item, row = index["item"][p], text[np.clip(end - 1, 0, len(text) - 1)]
    order = np.lexsort([edits, end, item, row])
    item, row, p, edits, end = (x[order] for x in (item, row, p, edits, end))
    if not len(p):
        return out
    # matches of one item that overlap are one place, told by the one of fewest edits
    place, _ = runs(np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (end[1:] - end[:-1] >= index["size"][p[1:]])))
    of = np.cumsum(np.isin(np.arange(len(p)), place))
    best = np.lexsort([np.arange(len(p)), edits, of])
    best = best[np.append(True, np.diff(of[best]) > 0)]
    for r, x, e, stop, size in zip(*(v.tolist() for v in (row[best], item[best], edits[best], end[best], index["size"][p[best]])), strict=True):
        stop -= int(begin[r]) + 1
        out[r].append({"item_id": x, "edits": e, "start": max(0, stop - size), "stop": stop})
    return out


def _aligned(codes: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, index: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the passages that match, their edits and where they end."""
    found = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(passage), 5000):
        p, d = passage[at : at + 5000], diagonal[at : at + 5000]
        edits, end = align(codes, p, d, index, width)
        ok = np.flatnonzero(edits <= index["edits"][p])
        found.append((at + ok, edits[ok], end[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_contamination(messages: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add ``contaminated``, ``n_items`` and ``matches`` to messages.

    messages(text, ...), benchmark(item_id, text).  Texts are compared in lower case with runs of
    white space as one blank, positions are characters of that form.  Every stretch of PASSAGE
    characters of an item, from any offset, is a passage (a shorter item is one as a whole); a
    message is contaminated where a passage occurs with at most EDITS hundredths of its length in
    edits.  So any piece of an item of PASSAGE characters is found, and an item with replaced words
    where PASSAGE characters between them are left.  Shared q-grams are counted in overlapping diagonal
    bands, bands that meet the edit budget's bound are aligned, and the alignment decides.
    ``matches`` is an array of (item_id, edits, start, stop), ``n_items`` its distinct items.

    The benchmark goes to the tasks in pieces of PIECE_CHARS characters, one pass over the messages
    each; messages are never shuffled.  Passages of fewer than Q characters hold no q-gram and match
    nothing.  Null or empty texts on either side match nothing; null item ids count as -1.  Repeated
    rows are judged one by one; an empty benchmark or table gives no match.
    """
    kind = ArrayType(StructType([StructField(k, LongType()) for k in ("item_id", "edits", "start", "stop")]))
    rows = messages.drop("contaminated", "n_items", "matches")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    pieces = max(1, -(-total // PIECE_CHARS))
    out = rows.withColumn("matches", F.array().cast(kind))
    for k in range(pieces):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == k).orderBy("item_id", "text").collect()
        out = _scan(out, passages([(r.item_id, r.text) for r in mine]), kind)
    found = F.size(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return out.select(*rows.columns, (F.size("matches") > 0).alias("contaminated"), found.cast("long").alias("n_items"), "matches")


def _scan(rows: DataFrame, index: dict, kind: ArrayType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    names = [c for c in rows.columns if c != "matches"]
    shape = pa.list_(pa.struct([(f.name, pa.int64()) for f in kind.elementType]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            found = [old + new for old, new in zip(t["matches"].to_pylist(), matched(t["text"].to_pylist(), shared.value), strict=True)]
            yield from t.select(names).append_column("matches", pa.array(found, shape)).to_batches()

    return rows.select(*names, "matches").mapInArrow(work, StructType([*(rows.schema[n] for n in names), StructField("matches", kind)]))

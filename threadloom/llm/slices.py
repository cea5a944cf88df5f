"""Windows of messages dealt to buckets as packed strings.

Consecutive windows whose smallest m-gram has the same value travel as one slice of the text: equal
windows have equal minimisers, so they meet in one bucket, and a slice carries each window's units
only about three times instead of once a window.  Slices that are equal inside a task are sent
once.  A bucket works out which windows also start earlier and says so as spans of the message.

A minimiser with more than ``HOT_BYTES`` of slices is hot: its windows are dealt one by one, by a
128-bit digest of the whole window, so equal ones still meet and no bucket holds a hot minimiser.

A place is (``at``, ``tag``, ``start``): the message's number in the order of its key (:func:`placed`),
a hash of its text, and the first unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from hashlib import blake2b
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from threadloom.llm.ragged import chunks, flat, ranges, runs, sliding_min
from threadloom.session import materialize

#: Columns that together name a message of the library.
KEY = ["dataset", "conv_id", "pos"]

#: Bytes of text, before packing, whose slices one bucket gets on average.
BUCKET_BYTES = 8_000_000
#: Bytes of slices of one minimiser from which on it is hot, estimated from one text in ``HOT_SAMPLE``
#: and every text of ``HOT_TEXT`` bytes.  The estimate only decides how windows are dealt, never what is found.
HOT_BYTES = 8_000_000
HOT_SAMPLE = 16
HOT_TEXT = 1 << 20
#: Bytes of text that are cut at a time; a longer text goes in pieces that overlap by a window less one unit.
PIECE_BYTES = 1 << 20

_PACKED = "part int, text binary, places binary, gone binary, hot binary"
_SPANS = "at bigint, tag int, start int, stop int"
_PLACE = [("at", "i8"), ("tag", "i2"), ("start", "i4"), ("n", "i4"), ("low", "u4"), ("multi", "u1")]
_GONE = [("at", "i8"), ("tag", "i2"), ("start", "i4"), ("stop", "i4")]
_HOT = [("at", "i8"), ("tag", "i2"), ("start", "i4"), ("a", "u8"), ("b", "u8")]
_ZSTD = pa.Codec("zstd", 6)


@dataclass
class Slices:
    """Slices of one chunk: ``low`` is the minimiser, ``n`` the number of windows."""

    text: list[bytes]
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    low: np.ndarray
    multi: np.ndarray


#: cut(raw, offsets) -> slices of the windows of these texts
Cut = Callable[[np.ndarray, np.ndarray], Slices]
#: split(text, piece bytes) -> (first unit, first byte, end) of overlapping pieces; each window starts in one of them
Split = Callable[[np.ndarray, int], list[tuple[int, int, int]]]
#: settle(slices, places) -> spans of windows that also start earlier
Settle = Callable[[list[bytes], dict], dict]
#: single(slice) -> its windows
Single = Callable[[bytes], list[bytes]]


def key_of(messages: DataFrame) -> list[str]:
    """The columns that name a message: (dataset, conv_id, pos) where all three are there, else msg_id."""
    return KEY if set(KEY) <= set(messages.columns) else ["msg_id"]


def numbers_serve(messages: DataFrame, key: list[str]) -> bool:
    """Whether the key is one column of whole numbers that no two rows share (a null is a value too)."""
    if len(key) > 1 or not isinstance(messages.schema[key[0]].dataType, IntegralType):
        return False
    return messages.groupBy(F.col(f"`{key[0]}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def numbered(messages: DataFrame, key: list[str]) -> DataFrame:
    """(at, row): messages in the order of ``key`` (nulls first), rows of one key by a hash of their text; equal ones share a number.

    Only keys and hashes are sorted: ranges of them over all tasks, each task numbers its own.  The
    numbers are written before the texts meet them, so a repeated task sees the same ones.
    """
    named = [f"k{i}" for i in range(len(key) + 1)]
    by = [F.col(f"`{c}`") for c in key] + [F.xxhash64(F.coalesce("text", F.lit("")))]
    order = [F.col(c).asc_nulls_first() for c in named]
    keys = messages.select(*[c.alias(n) for c, n in zip(by, named, strict=True)]).distinct()
    keys = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at"))
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), *[c.alias(f"m{n}") for c, n in zip(by, named, strict=True)])
    same = [F.col(n).eqNullSafe(F.col(f"m{n}")) for n in named]
    return rows.join(materialize(keys, "keys"), reduce(and_, same)).select("at", "row")


def placed(messages: DataFrame) -> DataFrame:
    """(at, tag, row): the place of a message, and all its columns as one struct, so that no name clashes.

    A column of whole numbers without a repetition is the place itself (null: before all others).
    Any other key, of any type and however often it repeats, is numbered in its order and written.
    """
    key = key_of(messages)
    if numbers_serve(messages, key):
        at = F.coalesce(F.col("msg_id").cast("long"), F.lit(-(2**63)))
        rows = messages.select(at.alias("at"), F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"))
    else:
        rows = materialize(numbered(messages, key), "placed")
    tag = F.pmod(F.hash(F.coalesce("row.text", F.lit(""))), F.lit(1 << 15))
    return rows.select("at", tag.alias("tag"), "row")


def buckets_for(messages: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets, from the bytes of all texts."""
    total = messages.agg(F.sum(F.octet_length("row.text").cast("long"))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def minimiser_runs(grams: np.ndarray, width: int, valid: np.ndarray):
    """Runs of valid windows (``width`` grams each) with one minimiser value.

    Returns first window, number of windows, value, and whether the value stands at more than one
    place of the run.
    """
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(key, width)[valid]
    value = low >> np.uint64(32)
    s, n = runs(np.concatenate([[True], (valid[1:] != valid[:-1] + 1) | (value[1:] != value[:-1])]))
    return valid[s], n, value[s].astype(np.uint32), low[s] != low[s + n - 1]


def in_pieces(cut: Cut, split: Split, size: int | None = None) -> Cut:
    """``cut`` over about ``size`` bytes at a time, so that its arrays are as small for a text of any length."""
    limit = size or PIECE_BYTES

    def work(raw: np.ndarray, off: np.ndarray) -> Slices:
        done, at, last = [], 0, len(off) - 1
        while at < last:
            if off[at + 1] - off[at] > limit:
                text = raw[off[at] : off[at + 1]]
                stop, todo = at + 1, [(first, text[a:b], np.array([0, b - a])) for first, a, b in split(text, limit)]
            else:
                stop = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
                todo = [(0, raw[off[at] : off[stop]], off[at : stop + 1] - off[at])]
            for first, data, ends in todo:
                s = cut(data, ends)
                if s.text:
                    done.append(replace(s, row=s.row + at, start=s.start + first))
            at = stop
        if not done:
            return Slices([], *(np.zeros(0, np.int64),) * 5)
        arrays = {k: np.concatenate([getattr(s, k) for s in done]) for k in ("row", "start", "n", "low", "multi")}
        return Slices([x for s in done for x in s.text], **arrays)

    return work


def hot_minimisers(messages: DataFrame, cut: Cut) -> np.ndarray:
    """Minimisers whose slices, once for each task that holds them, have more than ``HOT_BYTES``.

    There are at most as many as the slices of all texts have multiples of that.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            s = cut(*flat(t["text"]))
            if not s.text:
                continue
            once = np.fromiter(dict(zip(reversed(s.text), range(len(s.text) - 1, -1, -1), strict=True)).values(), np.int64)
            size = np.fromiter((len(s.text[k]) for k in once), np.int64, len(once)) * t["weight"].to_numpy()[s.row[once]]
            low, back = np.unique(s.low[once], return_inverse=True)
            total = np.bincount(back, size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(total)], ["low", "size"])

    long = F.coalesce(F.octet_length("row.text") >= HOT_TEXT, F.lit(False))
    some = messages.where(long | (F.pmod(F.xxhash64("at", "tag", "row.text"), F.lit(HOT_SAMPLE)) == 0))
    sizes = some.select("row.text", F.when(long, 1).otherwise(HOT_SAMPLE).cast("long").alias("weight")).mapInArrow(work, "low bigint, size bigint")
    hot = sizes.groupBy("low").agg(F.sum("size").alias("size")).where(F.col("size") > HOT_BYTES).collect()
    return np.array(sorted(r.low for r in hot), np.uint32)


def _pack(columns: dict, layout: list) -> bytes:
    out = []
    for name, kind in layout:
        x = np.asarray(columns[name]).astype(kind)
        x = np.diff(x, prepend=x[:1] * 0) if name == "at" and len(x) else x
        out.append(x.view("u1").reshape(len(x), x.itemsize).T.tobytes())  # equal bytes of the numbers stand together
    body = b"".join(out)
    return len(columns["at"]).to_bytes(8, "little") + _ZSTD.compress(body, asbytes=True) if body else b""


def _unpack(blob: bytes, layout: list) -> dict:
    if not blob:
        return {name: np.zeros(0, kind) for name, kind in layout}
    n = int.from_bytes(blob[:8], "little")
    body = _ZSTD.decompress(blob[8:], n * sum(np.dtype(k).itemsize for _, k in layout), asbytes=True)
    out, pos = {}, 0
    for name, kind in layout:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(body, "u1", n * size, pos).reshape(size, n).T.copy().view(kind)[:, 0]
        out[name] = np.cumsum(x) if name == "at" else x
        pos += n * size
    return out


def _compress(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + _ZSTD.compress(blob, asbytes=True)


def _decompress(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _settle_equal(text: list[bytes], place: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of equal slices only the first stays: (index that stays, index of later ones).

    ``place`` is sorted by (at, start).  A slice at the very place of the first one (a repeated
    row) is in neither list.
    """
    seen: dict[bytes, int] = {}
    first = np.fromiter((seen.setdefault(s, k) for k, s in enumerate(text)), np.int64, len(text))
    own = np.arange(len(text))
    later = (place["at"] != place["at"][first]) | (place["start"] != place["start"][first])
    return own[first == own], own[(first != own) & later]


def _spans(place: dict, width: int) -> dict:
    return {k: place[k] for k in ("at", "tag", "start")} | {"stop": place["start"] + place["n"] + width - 1}


def _take(columns: dict, idx: np.ndarray) -> dict:
    return {k: v[idx] for k, v in columns.items()}


def _singles(s: Slices, mine: np.ndarray, single: Single) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first unit, digest as two numbers) of every window of the slices ``mine``."""
    n = s.n[mine].astype(np.int64)
    digest = np.empty((int(n.sum()), 2), np.uint64)
    at = 0
    for i, k in zip(mine.tolist(), n.tolist(), strict=True):
        digest[at : at + k] = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in single(s.text[i])), np.uint64).reshape(-1, 2)
        at += k
    return np.repeat(mine, n), ranges(s.start[mine], n), digest


def _settle_digests(a: np.ndarray, b: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of one digest only the first stays: (index that stays, index of later ones)."""
    order = np.lexsort([start, at, b, a])
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return order[new], later_windows(group, at, start)[0]


def deal(messages: DataFrame, cut: Cut, width: int, parts: int, single: Single) -> DataFrame:
    """One row for each chunk and bucket: packed slices, their places, spans already settled, windows of hot minimisers."""
    hot = hot_minimisers(messages, cut)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            t = t.sort_by("at")
            at, tag = t["at"].to_numpy(), t["tag"].to_numpy()
            s = cut(*flat(t["text"]))
            if not s.text:
                continue
            place = {"at": at[s.row], "tag": tag[s.row], "start": s.start, "n": s.n, "low": s.low, "multi": s.multi}
            stay, later = _settle_equal(s.text, place)
            part = (s.low % np.uint32(parts)).astype(np.int64)
            is_hot = np.isin(s.low[stay], hot)
            of, start, digest = _singles(s, stay[is_hot], single)
            one, again = _settle_digests(digest[:, 0], digest[:, 1], place["at"][of], start)
            loose = merged(of[again], start[again], place, width)
            one = one[np.argsort(digest[one, 0] % np.uint64(parts), kind="stable")]
            to = (digest[one, 0] % np.uint64(parts)).astype(np.int64)
            ones = {"at": place["at"][of[one]], "tag": place["tag"][of[one]], "start": start[one], "a": digest[one, 0], "b": digest[one, 1]}
            stay = stay[~is_hot]
            stay, later = stay[np.argsort(part[stay], kind="stable")], later[np.argsort(part[later], kind="stable")]
            which = np.unique(np.concatenate([part, to]))
            cuts = [np.searchsorted(x, [which, which + 1]) for x in (part[stay], part[later], to)]
            rows = {"part": [], "text": [], "places": [], "gone": [], "hot": []}
            if len(loose["at"]):  # settled already: any bucket passes them on
                for k, v in (("part", int(which[0])), ("text", _compress(_join([]))), ("places", b""), ("gone", _pack(loose, _GONE)), ("hot", b"")):
                    rows[k].append(v)
            for k, p in enumerate(which.tolist()):
                mine, gone, lone = (x[c[0, k] : c[1, k]] for x, c in zip((stay, later, np.arange(len(one))), cuts, strict=True))
                rows["part"].append(p)
                rows["text"].append(_compress(_join([s.text[i] for i in mine])))
                rows["places"].append(_pack(_take(place, mine), _PLACE))
                rows["gone"].append(_pack(_spans(_take(place, gone), width), _GONE))
                rows["hot"].append(_pack(_take(ones, lone), _HOT))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("text", "places", "gone", "hot"))]))

    return messages.select("at", "tag", "row.text").mapInArrow(work, _PACKED)


def _join(slices: list[bytes]) -> bytes:
    lens = np.array([len(s) for s in slices], np.int32)
    return len(slices).to_bytes(8, "little") + lens.tobytes() + b"".join(slices)


def _parted(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    stops = np.cumsum(np.frombuffer(blob, np.int32, n, 8), dtype=np.int64) + 8 + 4 * n
    return [blob[a:b] for a, b in zip([8 + 4 * n, *stops[:-1].tolist()], stops.tolist(), strict=True)] if n else []


def settle(dealt: DataFrame, windows: Settle, width: int, parts: int) -> DataFrame:
    """Spans (at, tag, start, stop) of units that a window covers which also starts earlier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, places, ones = [], [], []
        for batch in batches:
            for row in batch.select(["text", "places", "gone", "hot"]).to_pylist():
                text += _parted(_decompress(row["text"]))
                places.append(_unpack(row["places"], _PLACE))
                if row["gone"]:
                    yield _rows(_unpack(row["gone"], _GONE))
                if row["hot"]:
                    ones.append(_unpack(row["hot"], _HOT))
        if ones:
            one = {k: np.concatenate([x[k] for x in ones]) for k, _ in _HOT}
            _, later = _settle_digests(one["a"], one["b"], one["at"], one["start"])
            yield _rows(_spans(_take(one | {"n": np.ones(len(one["at"]), np.int32)}, later), width))
        if not text:
            return
        place = {k: np.concatenate([p[k] for p in places]) for k, _ in _PLACE}
        order = np.lexsort([place["start"], place["at"]])
        place, text = _take(place, order), [text[i] for i in order]
        stay, later = _settle_equal(text, place)
        yield _rows(_spans(_take(place, later), width))
        # a minimiser that stands at one place of the bucket cannot belong to a repeated window
        low = place["low"][stay]
        _, back, n = np.unique(low, return_inverse=True, return_counts=True)
        stay = stay[(n[back] > 1) | (place["multi"][stay] > 0)]
        if len(stay):
            yield _rows(windows([text[i] for i in stay], _take(place, stay)))

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(work, _SPANS)


def _rows(spans: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(spans[k], t) for (k, _), t in zip(_GONE, kinds, strict=True)], [k for k, _ in _GONE])


def later_windows(group: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of windows that are later than the first of their group, and of that first one."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort([start, at, group])
    g = group[order]
    s, n = runs(np.concatenate([[True], g[1:] != g[:-1]]))
    first = np.repeat(order[s], n)
    later = (at[order] != at[first]) | (start[order] != start[first])
    return order[later], first[later]


def merged(row: np.ndarray, start: np.ndarray, place: dict, width: int) -> dict:
    """Spans of single windows, merged where they follow each other in one slice."""
    order = np.lexsort([start, row])
    row, start = row[order], start[order]
    if not len(row):
        return {k: np.zeros(0, kind) for k, kind in _GONE}
    s, n = runs(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
    return {"at": place["at"][row[s]], "tag": place["tag"][row[s]], "start": start[s], "stop": start[s] + n + width - 1}


def with_spans(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """(text, row, spans): what each message loses as (start, stop), null if it loses nothing."""
    mine = spans.groupBy("at", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return messages.join(mine, ["at", "tag"], "left").select("row.text", "row", "spans")


def unpacked(row: pa.ChunkedArray) -> pa.Table:
    """The columns of a struct column."""
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in row.chunks])


def spans_of(column: pa.ChunkedArray) -> Iterator[list[tuple[int, int]]]:
    """For each row the merged spans, in order."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    inner = column.flatten()
    start, stop = (np.asarray(inner.field(k)) for k in ("start", "stop"))
    n = np.asarray(column.value_lengths().fill_null(0))
    at = 0
    for k in n.tolist():
        if not k:
            yield []
            continue
        out: list[list[int]] = []
        for a, b in sorted(zip(start[at : at + k].tolist(), stop[at : at + k].tolist(), strict=True)):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        at += k
        yield [tuple(x) for x in out]

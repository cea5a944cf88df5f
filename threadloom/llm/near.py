"""Near-duplicate messages by HyperMinHash registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.links import link_components
from threadloom.llm.ragged import chunks, flat, mix, ranges, rolling, runs, split_words
from threadloom.llm.slices import numbered, numbers_serve
from threadloom.session import materialize

#: Registers of a sketch (a power of two), bits of their mantissa, and registers of a band.
REGISTERS = 256
MANTISSA = 10
BAND = 6
#: Estimates may fall below the wanted similarity by so much (five standard deviations of a sketch).
SLACK = 0.13
#: Members of one band bucket that are compared in one place; larger buckets are split into pairs of blocks.
BLOCK = 500

#: Fixed value: the constant of the expected number of equal registers of unrelated sets.
COLLISIONS = 0.169919487159739093975315012348630288992889

_EMPTY = np.uint16(0xFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SKETCH = "_at bigint, n_shingles bigint, set_hi bigint, set_lo bigint, registers binary"


def shingle_sets(texts: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (row, hash), sorted; A-Z count as a-z.

    A text with fewer words than a shingle has its whole word sequence as the only one.
    """
    raw, off = flat(texts)
    w = split_words(_LOWER[raw], off)
    h, n = w.hashes(), np.diff(w.first)
    rows, found = [], []
    for size in range(1, shingle + 1):
        mine = n >= shingle if size == shingle else n == size
        starts = ranges(w.first[:-1][mine], n[mine] - size + 1)
        if len(starts):
            rows.append(np.repeat(np.flatnonzero(mine), n[mine] - size + 1))
            found.append(mix(rolling(h, size)[starts] + np.uint64(size)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort([key, row])
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
    return row[new], key[new]


def registers(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash of each row: for every bucket the leading zeros and mantissa of its least hash.

    The first bits of a hash choose the bucket.  Buckets that stay empty copy a full one, chosen by
    a hash of the bucket alone, so equal buckets of two sets stay as likely as their similarity.
    """
    least = np.full(rows * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    bits = REGISTERS.bit_length() - 1
    value = mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)
    np.minimum.at(least, row * REGISTERS + (key >> np.uint64(64 - bits)).astype(np.int64), value)
    full = least != np.iinfo(np.uint64).max
    zeros = (53 - np.frexp(np.where(full, least, 0).astype(np.float64))[1]).astype(np.uint64)
    head = (least << zeros) & np.uint64((1 << 53) - 1)
    mantissa = (head >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.where(full, (zeros << np.uint64(MANTISSA)) | mantissa, _EMPTY).astype(np.uint16).reshape(rows, REGISTERS)
    known = np.bincount(row, minlength=rows) > 0
    r, b = np.nonzero((out == _EMPTY) & known[:, None])
    source, step = out.copy(), 0
    while len(r):
        step += 1
        donor = (mix(b.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(step)) >> np.uint64(20)).astype(np.int64) % REGISTERS
        got = source[r, donor]
        out[r, b] = got
        open_ = got == _EMPTY
        r, b = r[open_], b[open_]
    return out


def _sums(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    if len(row):
        s, _ = runs(np.append(True, row[1:] != row[:-1]))
        out[row[s]] = np.add.reduceat(value, s)
    return out.astype(np.int64)


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """One row a message: number of shingles, a 128-bit fingerprint of the set, registers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            row, key = shingle_sets(t["text"], shingle)
            regs = registers(row, key, len(t))
            yield pa.RecordBatch.from_arrays(
                [
                    t["_at"].combine_chunks(),
                    pa.array(np.bincount(row, minlength=len(t)), pa.int64()),
                    pa.array(_sums(row, mix(key ^ np.uint64(0x1234567)), len(t))),
                    pa.array(_sums(row, mix(key * np.uint64(0x9E3779B97F4A7C15)), len(t))),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["_at", "n_shingles", "set_hi", "set_lo", "registers"],
            )

    return rows.select("_at", "text").mapInArrow(work, _SKETCH)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw, off = flat(column)
    return raw.view(np.uint16).reshape(len(off) - 1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Hash of each band of registers, the number of the band included."""
    count = REGISTERS // BAND
    parts = regs[:, : count * BAND].reshape(-1, count, BAND).astype(np.uint64)
    key = np.arange(count, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def bands(classes: DataFrame) -> DataFrame:
    """(band, rep): one row for each band of registers of a class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = band_keys(_matrix(batch["registers"]))
            rep = np.repeat(batch["rep"].to_numpy(zero_copy_only=False), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["band", "rep"])

    return classes.select("rep", "registers").mapInArrow(work, "band bigint, rep bigint")


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity estimated from two sketches, less the equal registers expected by chance."""
    equal = (a == b).sum(axis=-1, dtype=np.int32)
    ratio = n / np.maximum(m, 1)
    chance = COLLISIONS * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (REGISTERS - chance)


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = (t[k].to_numpy(zero_copy_only=False) for k in ("na", "nb"))
            ok = similarity(_matrix(t["ra"]), _matrix(t["rb"]), n, m) >= least
            yield t.select(["a", "b"]).filter(pa.array(ok))

    side = lambda k: classes.select(F.col("rep").alias(k), F.col("registers").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(work, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "ta", 2_000_000):
            (ra, ka), (rb, kb) = (shingle_sets(t[k], shingle) for k in ("ta", "tb"))
            n = np.bincount(ra, minlength=len(t)) + np.bincount(rb, minlength=len(t))
            row, key = np.append(ra, rb), np.append(ka, kb)
            order = np.lexsort([key, row])
            row, key = row[order], key[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (key[1:] == key[:-1])], minlength=len(t))
            yield from t.select(["a", "b"]).filter(pa.array((100 * both >= percent * (n - both)) & (both > 0))).to_batches()

    # both sides grow with the data, so the plan never depends on one being small
    side = lambda k: rows.select(F.col("_at").alias(k), F.col("text").alias(f"t{k}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(work, "a bigint, b bigint").distinct()


def _likely_pairs(key: np.ndarray, band: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs (row numbers) of different components inside the groups of the sorted ``key``.

    A pair that shares several bands counts only in the first of them.
    """
    own = np.argmax(band_keys(regs) == band.view(np.uint64)[:, None], axis=1)
    parts = regs[:, : REGISTERS // BAND * BAND].reshape(len(regs), -1, BAND)
    for d in range(1, len(key)):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            return
        i = i[comp[i] != comp[i + d]]
        for at in range(0, len(i), 20_000):
            x = i[at : at + 20_000]
            x = x[similarity(regs[x], regs[x + d], n[x], n[x + d]) >= least]
            first = np.argmax((parts[x] == parts[x + d]).all(axis=2), axis=1)
            x = x[first == own[x]]
            if len(x):
                yield x, x + d


def _confirmed(texts: pa.ChunkedArray, pairs: list[tuple[np.ndarray, np.ndarray]], shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs of one group; pairs that are connected by then are passed over."""
    row, key = shingle_sets(texts, shingle)
    _, code = np.unique(key, return_inverse=True)
    size = np.bincount(row, minlength=len(texts))
    first = np.cumsum(size) - size
    top = list(range(len(texts)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    s, n = runs(np.append(True, a[1:] != a[:-1]))
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    out = []
    for x, others in zip(a[s].tolist(), np.split(b, s[1:]), strict=True):
        others = others[[root(y) != root(x) for y in others.tolist()]]
        if not len(others):
            continue
        mine = code[first[x] : first[x] + size[x]]
        mark[mine] = True
        hit = mark[code[ranges(first[others], size[others])]]
        both = np.add.reduceat(hit, np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[mine] = False
        for y in others[100 * both >= percent * (size[x] + size[others] - both)].tolist():
            if root(x) != root(y):
                top[max(root(x), root(y))] = min(root(x), root(y))
                out.append((x, y))
    return out


def linked_across(members: DataFrame, classes: DataFrame, rows: DataFrame, least: float, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside band buckets whose members are not all of one component.

    Members of a bucket are compared by registers where they meet.  Those that have a likely partner
    in another component come together once more with their texts, and the pairs are confirmed
    there, so neither step lists pairs: a bucket gives at most one link less than it has members.  A
    bucket of more than ``BLOCK`` members is dealt to pairs of blocks; every pair still meets.
    """
    mixed = members.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).where("_lo < _hi")
    n = F.ceil(F.col("_n") / BLOCK)
    got = members.join(mixed.select("band", "_n"), "band").join(classes.select("rep", "registers", "n_shingles"), "rep")
    got = got.select("rep", "comp", "registers", "n_shingles", "band", n.alias("_blocks"), F.pmod(F.xxhash64("rep"), n).alias("_own"))
    got = got.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    got = got.withColumn("_bucket", F.xxhash64("band", F.least("_own", "_other"), F.greatest("_own", "_other")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "_bucket"):
            key, band, comp, n = (t[k].to_numpy() for k in ("_bucket", "band", "comp", "n_shingles"))
            hit = np.zeros(len(t), bool)
            for x, y in _likely_pairs(key, band, comp, n, _matrix(t["registers"]), least):
                hit[x] = hit[y] = True
            yield from t.select(["_bucket", "band", "rep", "comp"]).filter(pa.array(hit)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "_bucket"):
            all_keys = t["_bucket"].to_numpy()
            s, n = runs(np.append(True, all_keys[1:] != all_keys[:-1]))
            for at, size in zip(s.tolist(), n.tolist(), strict=True):
                g = t.slice(at, size)
                key, band, comp, rep = (g[k].to_numpy() for k in ("_bucket", "band", "comp", "rep"))
                row, found = shingle_sets(g["text"], shingle)
                regs = registers(row, found, size)
                pairs = list(_likely_pairs(key, band, comp, np.bincount(row, minlength=size), regs, least))
                links = _confirmed(g["text"], pairs, shingle, percent) if pairs else []
                if links:
                    a, b = (rep[[x[k] for x in links]] for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    cols = ["_bucket", "band", "rep", "comp", "n_shingles", "registers"]
    dealt = got.select(*cols).repartition("_bucket").sortWithinPartitions("_bucket")
    likely_ones = materialize(dealt.mapInArrow(find, "_bucket bigint, band bigint, rep bigint, comp bigint"), "likely")
    full = likely_ones.join(rows.select(F.col("_at").alias("rep"), "text").hint("merge"), "rep").select("_bucket", "band", "rep", "comp", "text")
    return full.repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(confirm, "a bigint, b bigint").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which every group of the sorted column ``key`` is complete."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch[key][-1].as_py()
        col = batch[key].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(col, last))
        if cut or (held and held[-1][key][-1].as_py() != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(messages: DataFrame, shingle: int = 5, percent: int = 80, key: list[str] | None = None) -> DataFrame:
    """Components of messages whose shingle sets are similar.

    messages(msg_id, text, ...) -> msg_id, n_shingles, component_id, kept.  ``key`` names messages
    otherwise, as by ["dataset", "conv_id", "pos"]: those columns come instead of msg_id, and
    component_id is a struct of them.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a message's set has its distinct
    shingles of ``shingle`` words (with fewer words: the whole sequence).  Two messages are linked
    where 100 * intersection >= ``percent`` * union.  ``component_id`` is the smallest msg_id that
    is reachable over links, ``kept`` says that it is the message's own.

    1. Messages of one set form a class, led by its smallest id.
    2. Classes that share a band of registers meet.  First each is paired with the smallest member
       of its buckets (no bucket lists its pairs); likely pairs are confirmed on the full sets.
    3. Buckets that still hold several components compare the members of different components
       by their registers, block by block, and confirm likely pairs there on the full sets.
    A pair of similarity 0.8 shares no band with a chance of 3e-6, less above.

    Null or empty text, or no word: empty set, linked with nothing, kept.  A key has any type, a null
    is the smallest.  Rows that repeat a key are told apart by their text: each is compared by
    itself, ordered by a hash of the text; rows of one key and one text are one message.  A message
    is kept if it is the first of its component.  Other columns are not kept.  An empty table gives
    an empty result.
    """
    key = key or ["msg_id"]
    if numbers_serve(messages, key):
        nothing = F.lit(-(2**63))
        mine = F.col(f"`{key[0]}`")
        found = _components(messages.select(F.coalesce(mine.cast("long"), nothing).alias("_at"), "text"), shingle, percent)
        known = lambda c: F.nullif(F.col(c), nothing).cast(messages.schema[key[0]].dataType)
        return found.select(known("_at").alias(key[0]), "n_shingles", known("_first").alias("component_id"), "kept")
    rows = materialize(numbered(messages.select(*key, "text"), key), "placed")
    once = materialize(rows.groupBy("at").agg(F.first("row").alias("row")), "once")
    found = materialize(_components(once.select(F.col("at").alias("_at"), "row.text"), shingle, percent), "found")
    name = F.col(f"row.`{key[0]}`") if len(key) == 1 else F.struct(*[F.col(f"row.`{c}`") for c in key])
    out = found.join(once.select(F.col("at").alias("_first"), name.alias("component_id")), "_first")
    out = out.join(rows, F.col("_at") == F.col("at"))
    return out.select(*[F.col(f"row.`{c}`") for c in key], "n_shingles", "component_id", "kept")


def _components(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(_at, text) of one row a message -> (_at, n_shingles, _first, kept)."""
    least = percent / 100 - SLACK
    sketch = materialize(sketches(rows, shingle), "sketches")
    filled = sketch.where("n_shingles > 0")
    classes = materialize(
        filled.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("_at").alias("rep"), F.first("registers").alias("registers")), "classes"
    )
    dealt = bands(classes)
    hubs = materialize(dealt.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "hubs")
    members = materialize(dealt.join(hubs, "band"), "members")
    stars = members.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(verified(likely(stars, classes, least), rows, shingle, percent), "links")
    comp = link_components(links, "a", "b")
    known = members.join(comp, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("comp", "rep").alias("comp"))
    more = materialize(linked_across(known, classes, rows, least, shingle, percent), "links")
    if not more.isEmpty():
        comp = link_components(links.unionByName(more), "a", "b")
    led = classes.select("set_hi", "set_lo", "n_shingles", "rep").join(comp, F.col("rep") == F.col("node"), "left")
    led = led.select("set_hi", "set_lo", "n_shingles", F.coalesce("comp", "rep").alias("_comp"))
    out = sketch.drop("registers").join(led, ["set_hi", "set_lo", "n_shingles"], "left")
    first = F.coalesce("_comp", "_at")
    return out.select("_at", "n_shingles", first.alias("_first"), (first == F.col("_at")).alias("kept"))

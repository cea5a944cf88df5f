"""Token counts of messages under a byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from threadloom.llm.ragged import chunks, flat

#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose counts a task remembers.
REMEMBERED = 400_000

_NONE = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


def read_merges(path: str) -> dict:
    """Tables of a tokenizer file: token of each byte, sorted pairs with rank and result, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not model.get("continuing_subword_prefix")
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take their surroundings")
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, to = (np.array([vocab[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs), strict=True))
    key = left << 32 | right
    order = np.argsort(key, kind="stable")
    return {
        "byte": np.array([vocab[c] for c in byte_names()], np.int64),
        "key": key[order],
        "rank": order.astype(np.int32),
        "to": to.astype(np.int64),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def _ranks(left: np.ndarray, right: np.ndarray, merges: dict) -> np.ndarray:
    key = left << 32 | right
    at = np.minimum(np.searchsorted(merges["key"], key), len(merges["key"]) - 1)
    return np.where(merges["key"][at] == key, merges["rank"][at], _NONE)


def symbols_left(raw: np.ndarray, off: np.ndarray, merges: dict) -> np.ndarray:
    """Symbols that are left of each byte string after all merges.

    All strings are merged together: a round finds the lowest rank of each string and applies that
    pair wherever it stands in it, from the left where it overlaps itself.  A pair made by a merge
    has a higher rank than the merge, so a round never overtakes a pair.
    """
    left = np.diff(off)
    tok, seq = merges["byte"][raw], np.repeat(np.arange(len(left)), left)
    rank = _pair_ranks(tok, seq, merges)
    while len(tok):
        s = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        n = np.diff(np.append(s, len(seq)))
        best = np.minimum.reduceat(rank, s)
        live = best < _NONE
        if not live.all():  # finished strings leave
            keep = np.repeat(live, n)
            tok, seq, rank, best, n = tok[keep], seq[keep], rank[keep], best[live], n[live]
            if not len(tok):
                break
        hit = rank == np.repeat(best, n)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # in a run of overlapping hits every second one counts
            run = np.cumsum(np.append(True, at[1:] != at[:-1] + 1))
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
        tok[at] = merges["to"][rank[at]]
        keep = np.ones(len(tok), bool)
        keep[at + 1] = False
        np.subtract.at(left, seq[at], 1)
        to = np.cumsum(keep) - 1
        tok, seq, rank = tok[keep], seq[keep], rank[keep]
        fresh = np.unique(np.concatenate([to[at], np.maximum(to[at] - 1, 0)]))
        nxt = np.minimum(fresh + 1, len(tok) - 1)
        same = (seq[fresh] == seq[nxt]) & (nxt > fresh)
        rank[fresh] = np.where(same, _ranks(tok[fresh], tok[nxt], merges), _NONE)
    return left


def _pair_ranks(tok: np.ndarray, seq: np.ndarray, merges: dict) -> np.ndarray:
    rank = np.full(len(tok), _NONE, np.int32)
    if len(tok) > 1:
        rank[:-1] = np.where(seq[1:] == seq[:-1], _ranks(tok[:-1], tok[1:], merges), _NONE)
    return rank


class Counter:
    """Tokens of texts; pre-tokens seen before are looked up."""

    def __init__(self, merges: dict):
        self.merges = merges
        self.find = regex.compile(PIECES).findall
        specials = sorted(merges["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and special strings, each of which is one token."""
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1

    def count(self, texts: list[str | None]) -> np.ndarray:
        words, n, extra = [], [], []
        for text in texts:
            got, special = self.pieces(text or "")
            words += got
            n.append(len(got))
            extra.append(special)
        out = np.array(extra, np.int64)
        if words:
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            each = self._symbols(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            ends = np.cumsum(np.append(0, each))
            stop = np.cumsum(n)
            out += ends[stop] - ends[stop - n]
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        if new:
            self.known.update(zip(new, symbols_left(*flat(pa.array(new, pa.large_string())), self.merges).tolist(), strict=True))
        return np.array([self.known[w] for w in words], np.int64)


def token_counts(messages: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > ``limit``) to messages.

    messages(text, ...); ``tokenizer`` is the path, on the driver, of a byte-level BPE file.  Counts
    are those of its library without begin or end tokens; a special string inside a text is one
    token.  The merge table is broadcast: its size is that of the vocabulary file, not of the data.

    Null or empty text: 0 bytes, 0 tokens.  Every row is counted on its own, repeated ones as well;
    an empty table gives an empty result.
    """
    new = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    rows = messages.drop(*[f.name for f in new])
    merges = messages.sparkSession.sparkContext.broadcast(read_merges(tokenizer))
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for t in chunks(batches):
            n = counter.count(t["text"].to_pylist())
            size = pc.fill_null(pc.binary_length(t["text"]), 0).cast(pa.int64())
            out = t.select(names).append_column("n_bytes", size).append_column("n_tokens", pa.array(n, pa.int64()))
            yield from out.append_column("over_limit", pa.array(n > limit)).to_batches()

    return rows.mapInArrow(work, StructType([*rows.schema.fields, *new]))

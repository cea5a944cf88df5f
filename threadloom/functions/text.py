"""Text expressions; all of them are built-in column functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns define what counts as a mention.
MENTION = r"<@([^>|@\]\n]{1,60})>"
MENTION_LOOSE = r"<@([^>]+)>"
ADDRESS = r"^([A-Za-z0-9_\|\-\{\}\[\]\^`]+)\s*[:,]"
HASH_BUCKETS = 20000
# Fixed value: what counts as white space between words.
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mentions(text: str | Column, pattern: str = MENTION) -> Column:
    """All mentioned names in order of appearance."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), 1)


def addressee(text: str | Column) -> Column:
    """Lower-case name in front of a leading ``name:`` or ``name,``; NULL if there is none."""
    got = F.regexp_extract(_c(text), ADDRESS, 1)
    return F.when(got != "", F.lower(got))


def squeeze(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(_c(text)), BLANKS + "+", "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (lambdas would repeat it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(text: str | Column) -> Column:
    """Distinct character trigrams of the lower-cased text without white space."""

    def cut(chars: Column) -> Column:
        n = F.size(chars)
        three = lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2))
        whole = F.filter(F.array(F.array_join(chars, "")), lambda s: s != "")
        return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), three))).otherwise(whole)

    return let(F.split(squeeze(text), ""), cut)


def md5_bucket(value: str | Column, buckets: int = HASH_BUCKETS) -> Column:
    """md5 as a 128-bit number modulo ``buckets``, from four 32-bit parts (stays in BIGINT)."""

    def fold(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for part in range(4):
            word = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long")
            out = F.pmod(out * (2**32 % buckets) + word, F.lit(buckets))
        return out

    return let(F.md5(_c(value)), fold)


def words(text: str | Column) -> Column:
    """Lower-cased white-space separated words."""
    return F.filter(F.split(F.lower(_c(text)), BLANKS + "+"), lambda w: w != "")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the size of the smaller set; 0 if a side is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    smaller = F.least(F.size(x), F.size(y))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / smaller)


def speaker(name: str | Column) -> Column:
    return F.lower(F.trim(_c(name)))


def unescape(text: Column) -> Column:
    """Decode HTML character references (Arrow batches; the full table is the standard library's)."""
    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(html.unescape, na_action="ignore")

    return decode(text)


def strip_html(markup: str | Column) -> Column:
    """Tags become blanks, character references are decoded, runs of blanks are squeezed."""
    plain = unescape(F.regexp_replace(_c(markup), r"<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(plain, BLANKS + "+", " "), "^ | $", "")


def pseudonym(author: str | Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), _c(author)), 256)
    return F.concat(F.lit("u_"), F.substring(digest, 1, 8))

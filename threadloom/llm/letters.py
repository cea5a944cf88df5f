"""Texts as arrays of code points."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Ends a text; never part of one.
END = np.uint32(0)
_BLANK = np.uint32(32)


@cache
def is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@cache
def is_blank() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x3001)])


def code_points(texts: list[str | None]) -> np.ndarray:
    """Lower-cased code points of all texts, each between two blanks and followed by ``END``."""
    joined = "".join(f" {(t or '').lower()} ".replace("\0", " ") + "\0" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(codes: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Turn the marked places into blanks, and runs of them into one."""
    out = np.where(blank, _BLANK, codes)
    twice = np.append(False, blank[1:] & blank[:-1])
    return out[~twice]


def letters_only(texts: list[str | None]) -> np.ndarray:
    codes = code_points(texts)
    return squeezed(codes, ~is_letter()[codes] & (codes != END))


def blanks_squeezed(texts: list[str | None]) -> np.ndarray:
    codes = code_points(texts)
    return squeezed(codes, is_blank()[np.minimum(codes, 0x3000)])


def texts_of(codes: np.ndarray) -> np.ndarray:
    """Number of the text that each place belongs to."""
    end = codes == END
    return np.cumsum(end) - end

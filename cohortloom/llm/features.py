"""Hashed n-gram features of texts as numpy arrays, shared by the linear models."""

from __future__ import annotations

from functools import cache

import numpy as np

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Code points whose n-grams are made at a time.
PIECE = 1 << 20


def char_buckets(c: np.ndarray, orders: tuple[int, ...], bits: int):
    """Buckets below 2**bits of the character n-grams of every order, in parts: (order, buckets)."""
    shift = np.uint32(32 - bits)
    for a in range(0, len(c), PIECE):
        part = c[a : a + PIECE + max(orders) - 1]
        h = part * _A
        for n in range(1, max(orders) + 1):
            if n > 1:
                if len(part) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _B + part[n - 1 :] * _A
            if n in orders:
                yield n, (((h[:PIECE] ^ (h[:PIECE] >> np.uint32(13))) + np.uint32(n)) * _C) >> shift


def letters_only(text: str) -> np.ndarray:
    """Lower-case letters, each run of anything else as one blank; empty if the text has no letter."""
    c = codepoints(text.lower())
    is_letter = letters()[c]
    if not is_letter.any():
        return c[:0]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate([[np.uint32(32)], np.where(is_letter, c, np.uint32(32))[keep]])


_BLANK = np.zeros(0x110000, bool)
_BLANK[[*range(9, 14), 32, 0x85, 0xA0]] = True
_PLACES = np.random.default_rng(7).integers(1, 2**32, 64, np.uint32) | np.uint32(1)


def word_hashes(c: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each run of non-blank code points."""
    out = []
    at = 0
    while at < len(c):
        end = min(len(c), at + PIECE)
        while end < len(c) and not _BLANK[c[end]]:  # up to the end of a word
            gap = np.flatnonzero(_BLANK[c[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(len(c), end + PIECE)
        out.append(_word_hashes(c[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _word_hashes(c: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(~_BLANK[c])
    if not len(at):
        return np.empty(0, np.uint32)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return np.add.reduceat((c[at] + np.uint32(1)) * _PLACES[place & 63], starts, dtype=np.uint32)

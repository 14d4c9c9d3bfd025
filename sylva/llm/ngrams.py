"""Hashed features of whole texts, computed on their UTF-8 bytes with numpy: character n-grams and words."""

from __future__ import annotations

import numpy as np

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def as_bytes(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text with a space on either side, so that n-grams know where words begin and end."""
    return np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)


def ngrams(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket in [0, 2**bits) of each run of n bytes."""
    if len(raw) < n:
        return np.zeros(0, np.uint32)
    wide = raw.astype(np.uint32)
    out = wide[: len(raw) - n + 1] * _ODD[0]
    for k in range(1, n):
        out ^= out >> np.uint32(15)
        out += wide[k : len(raw) - n + 1 + k] * _ODD[k]
        out *= _ODD[5]
    return out >> np.uint32(32 - bits)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))
    return _powers


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _BASE
        return h ^ (h >> np.uint64(32))


def words(raw: np.ndarray) -> np.ndarray:
    """The hash of each word of a text."""
    return span_hashes(raw, *word_spans(raw))

"""Vectorised 64-bit hashing of words, phrases and shingles over raw UTF-8 bytes (numpy, no per-word objects)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = re.compile(rb"[\x09-\x0d ]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a multi-byte character; all other bytes divide terms.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = True
TERM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int, key: str, base: np.uint64) -> np.ndarray:
    p = _powers[key]
    if len(p) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.multiply.accumulate(p)
        _powers[key] = p
    return p[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``symbols[start:end]`` (uint64 symbols); equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(symbols)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power(n, "up", _BASE), out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * _power(n + 1, "down", _INVERSE)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in pieces of about ``limit`` bytes that end at white space."""
    at = 0
    while len(text) - at > limit:
        space = _SPACE.search(text, at + limit)
        stop = space.start() if space else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def words(group: list[bytes], limit: int = 1 << 19, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts in order, and where each text's words begin (len(group) + 1).

    A word is a run of bytes other than 0x20 and 0x09-0x0D; with ``terms``, a run of letters and digits
    (any byte from 0x80 counts as a letter). Only A-Z are lower-cased.
    """
    inside_of = TERM if terms else ~SPACE
    if len(group) == 1 and len(group[0]) > 2 * limit:
        found = [words([p], len(p), terms)[0] for p in _pieces(group[0], limit)]
        flat = np.concatenate(found)
        return flat, np.array([0, len(flat)])
    lengths = np.fromiter((len(t) + 1 for t in group), np.int64, len(group))
    raw = LOWER[np.frombuffer(b"\n".join(group) + b"\n", np.uint8)]
    starts, ends = spans(inside_of[raw])
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return span_hashes(byte_symbols(raw), starts, ends), bounds


def word_spans(group: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``words`` for texts that are not over-long: also the lower-cased bytes and each word's start and end in them."""
    lengths = np.fromiter((len(t) + 1 for t in group), np.int64, len(group))
    raw = LOWER[np.frombuffer(b"\n".join(group) + b"\n", np.uint8)]
    starts, ends = spans(~SPACE[raw])
    return raw.tobytes(), starts, ends, span_hashes(byte_symbols(raw), starts, ends), np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def pieces(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about ``limit`` bytes, long ones cut at white space; yields (text numbers, pieces)."""
    owners: list[int] = []
    group: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        for p in _pieces(t, limit) if len(t) > 2 * limit else [t]:
            owners.append(i)
            group.append(p)
            held += len(p)
            if held >= limit:
                yield owners, group
                owners, group, held = [], [], 0
    if group:
        yield owners, group


def terms(group: list[bytes], prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the lower-cased terms of each text, then of their prefixes in bytes; yields (text numbers, hashes)."""
    lengths = np.fromiter((len(t) + 1 for t in group), np.int64, len(group))
    raw = LOWER[np.frombuffer(b"\n".join(group) + b"\n", np.uint8)]
    starts, ends = spans(TERM[raw])
    of = np.searchsorted(np.cumsum(lengths), starts, "right")
    symbols = byte_symbols(raw)
    yield of, span_hashes(symbols, starts, ends)
    for k in prefixes:
        longer = ends - starts > k
        yield of[longer], span_hashes(symbols, starts[longer], starts[longer] + k) ^ np.uint64(0xA5A5A5A5A5A5A5A5)

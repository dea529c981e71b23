"""Words and five-word shingles of many texts at once, as 64-bit hashes.

A text is lower-cased in A-Z only and its words are the runs of bytes outside
``[\\x20\\x09-\\x0D]``.  A text of fewer than ``width`` words but at least one
has a single shingle, the whole sequence; one without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Texts are hashed together until their bytes pass this; a longer one goes alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = [_U(int(x) | 1) for x in _rng.integers(1, 2**63, 64)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        fill = np.full(max(n, CHUNK_BYTES + 1), _U(base), dtype=_U)
        fill[0] = 1
        have = np.cumprod(fill, dtype=_U)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _words(parts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word's place for each text (with an end)."""
    joined = b" ".join(parts)
    buf = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.concatenate(([0], np.cumsum(lens + 1)))
    if not len(buf):
        return np.empty(0, _U), np.zeros(len(parts) + 1, np.int64)
    inside = np.concatenate(([False], ~_SPACE[buf], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), dtype=_U)))
    hashes = mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(buf))[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, begins)


def _combine(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.full(max(n, 0), _U(width) * _STEP[63], dtype=_U)
    for k in range(width):
        out += words[k : k + len(out)] * _STEP[k]
    return mix(out)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending: sorting so few costs less than the hash table of ``np.unique``."""
    values = np.sort(values)
    fresh = np.empty(len(values), bool)
    fresh[:1] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def word_chunks(texts: list[str | bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, offsets) for runs of texts."""
    parts, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b""
        if parts and size + len(raw) > CHUNK_BYTES:
            yield (first, *_words(parts))
            parts, size, first = [], 0, i
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield (first, *_words(parts))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending."""
    for _, words, at in word_chunks(texts):
        full = _combine(words, width)
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= width:
                yield _distinct(full[s : e - width + 1])
            elif e > s:
                yield _combine(words[s:e], int(e - s))
            else:
                yield np.empty(0, _U)


def gram_sets(texts: list[str | None], widths: list[int]) -> Iterator[dict[int, np.ndarray]]:
    """For each text its distinct runs of exactly so many words, ascending, by width."""
    for _, words, at in word_chunks(texts):
        full = {w: _combine(words, w) for w in widths}
        for s, e in zip(at[:-1], at[1:], strict=True):
            yield {w: _distinct(full[w][s : max(s, e - w + 1)]) for w in widths}


def set_hash(shingles: np.ndarray) -> int:
    """Signed 64-bit identity of an ascending set of shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)

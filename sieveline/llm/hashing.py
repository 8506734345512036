"""64-bit hashes of words, shingles and windows over whole texts, in NumPy.

A batch of texts is laid out as one byte array.  Every byte has a random 64-bit value; a word's hash is the polynomial
of its bytes' values modulo 2**64, read off a prefix sum, then mixed.  Equal words have equal hashes; that two unequal
words share one has a chance of about 2**-64 (for words of a few dozen bytes).
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes laid out at a time.
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept and extended."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 2)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words in ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    solid = np.zeros(n + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * powers(_BASE, n), out=prefix[1:])
    word = (prefix[ends] - prefix[starts]) * powers(_INVERSE, n)[starts]
    return mix(word), starts


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, one text after the other, and where each text's words begin (one more at the end).

    Words are runs of bytes other than ASCII white space.
    """
    found, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    part: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal part, first, size
        if part:
            offsets = np.cumsum([0] + [len(x) + 1 for x in part])
            words, starts = _chunk_words(b" ".join(part))
            counts[first + 1 : upto + 1] = np.diff(np.searchsorted(starts, offsets))
            found.append(words)
        part, first, size = [], upto, 0

    for i, text in enumerate(texts):
        body = text or b""
        if len(body) > CHUNK:  # by itself, cut at white space
            flush(i)
            at = 0
            while at < len(body):
                end = min(at + CHUNK, len(body))
                while end < len(body) and not _SPACE[body[end]]:
                    end += 1
                words, _ = _chunk_words(body[at:end])
                found.append(words)
                counts[i + 1] += len(words)
                at = end
            first = i + 1
            continue
        part.append(body)
        size += len(body) + 1
        if size >= CHUNK:
            flush(i + 1)
    flush(len(texts))
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    return flat, np.cumsum(counts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; fewer words (but not none) make one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for d in range(1, size):
        out = mix(out * _BASE + words[d : n - size + 1 + d])
    return out


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of every window of ``size`` words by a prefix sum; none if there are fewer words."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    base = mix(np.asarray([salt + 1], dtype=np.uint64))[0] | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * powers(base, n), out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * powers(inverse, n)[: n - size + 1])

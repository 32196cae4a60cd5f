"""Vectorised text helpers that run inside tasks: words, windows and their hashes.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; words
are compared by 64-bit polynomial hashes over random byte values (arithmetic
modulo 2**64), which numpy computes for a whole text at once.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_ODD = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: white space and every other ASCII sign: what stands between runs of letters and digits
_SIGN = np.zeros(256, bool)
_SIGN[:128] = [not chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: one random 64-bit value per byte value
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: bytes hashed at once; a longer text is taken in pieces that end at a space
PIECE = 1 << 20


@lru_cache(maxsize=8)
def _powers(odd: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and odd**-i modulo 2**64 for i < size."""
    inverse = pow(odd, -1, 1 << 64)

    def table(base):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)
    return table(odd), table(inverse)


def powers(odd: np.uint64, length: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(length).bit_length())
    up, down = _powers(int(odd), size)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    return x ^ (x >> np.uint64(32))


def _piece_words(a: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.ones(len(a) + 2, np.int8)
    space[1:-1] = between[a]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(_ODD, len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:len(a)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


#: keeps the first k of eight bytes
_HEAD = np.array([0, *(((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9))], np.uint64)
#: bytes of a span that its key holds
KEYED = 32


def span_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """First span of every class of equal spans, and the class of each span; None if hashes collide.

    Spans of up to ``KEYED`` bytes are compared byte by byte, eight at a time; each longer one is a class of its own.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))
    length = ends - starts
    columns, key = [], mix(length.astype(np.uint64))
    for first in range(0, KEYED, 8):
        own = np.flatnonzero(length > first)
        if not len(own):
            break
        column = np.zeros(len(starts), np.uint64)
        column[own] = windows[starts[own] + first].astype(np.uint64) & _HEAD[np.minimum(length[own] - first, 8)]
        key = mix(key * _WORD_ODD + column)
        columns.append(column)
    long = np.flatnonzero(length > KEYED)
    key[long] = mix(key[long] + mix(long.astype(np.uint64) + np.uint64(1)))
    _, heads, classes = np.unique(key, return_index=True, return_inverse=True)
    equal = all((c == c[heads][classes]).all() for c in [*columns, length])
    return (heads, classes) if equal and (heads[classes[long]] == long).all() else None


def words(data: bytes, lower: bool = False, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word; ``lower`` folds A-Z, ``signs`` splits at ASCII signs too."""
    between = _SIGN if signs else _SPACE
    whole = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole) and not between[whole[end]]:
            ahead = np.flatnonzero(between[whole[end:end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(whole), end + PIECE)
        piece = whole[at:end]
        h, s, e = _piece_words(_LOWER[piece] if lower else piece, between)
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_ODD, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:n], least[width - have:width - have + n])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the long values Spark holds."""
    return x.view(np.int64)

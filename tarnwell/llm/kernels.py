"""Vectorised text kernels shared by the training-data operators.

Everything works on UTF-8 bytes with numpy, in blocks of about a megabyte, so the memory of a call
follows the block size and not the length of a text. White space is the byte set 0x20, 0x09-0x0D;
a word is a maximal run of other bytes, which on UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
LONG_WORD = 1 << 16  # longer words are hashed by digest, so that a block stays small
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the first k of eight bytes
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    return out


def inverse(base: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


class _Powers:
    """Powers of a base and of its inverse, grown when a longer block needs them."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, powers(base, 0), powers(base, 0)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096)
            self.up, self.down = powers(self.base, size), powers(inverse(self.base), size)
        return self.up[:n], self.down[:n]


def eights_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one little-endian number; behind the end stand zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span of ``data`` (a block of bounded size).

    A span is cut into numbers of eight bytes; each is mixed with its place in the span before they
    are added up, so neither repeated nor exchanged parts cancel.
    """
    size = end - start
    eights = eights_of(data)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(eights[start] & FIRST_BYTES[np.minimum(size, 8)])
    rows, place = np.flatnonzero(size > 8), 1
    while len(rows):
        left = size[rows] - 8 * place
        value = eights[start[rows] + 8 * place] & FIRST_BYTES[np.minimum(left, 8)]
        out[rows] += mix64(value ^ np.uint64(place * 0xD6E8FEB86659FD93 % (1 << 64)))
        rows, place = rows[left > 8], place + 1
    return mix64(out)


def _blocks(data: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about ``size`` bytes, cut behind white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n:
            space = np.flatnonzero(_IS_SPACE[data[end : end + 4096]])
            if len(space):
                end += int(space[0]) + 1
                break
            end = min(n, end + 4096)
        yield at, data[at:end]
        at = end


def words_of(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of ``data``: byte offsets and a 64-bit hash of its bytes.

    lower: ASCII letters are hashed in lower case.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    starts, ends, hashes = [], [], []
    for at, block in _blocks(whole, BLOCK):
        if lower:
            block = _ASCII_LOWER[block]
        solid = np.zeros(len(block) + 2, dtype=np.int8)
        solid[1:-1] = ~_IS_SPACE[block]
        turn = np.flatnonzero(np.diff(solid))
        start, end = turn[0::2], turn[1::2]
        if not len(start):
            continue
        usual = end - start <= LONG_WORD
        value = np.zeros(len(start), dtype=np.uint64)
        value[usual] = span_hashes(block, start[usual], end[usual])
        for i in np.flatnonzero(~usual):
            value[i] = int.from_bytes(hashlib.blake2b(block[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        starts.append(start + at)
        ends.append(end + at)
        hashes.append(value)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def word_lists(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in a row, and the bounds of each text in them (len + 1 offsets)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    start, _, value = words_of(b"\n".join(texts), lower)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(start, np.cumsum(sizes))
    return value, bounds


class Windows:
    """Rolling hashes of ``size`` consecutive words: two independent 64-bit values a window."""

    _bases = (_Powers(0xA24BAED4963EE407), _Powers(0x9FB21C651E98DF25))

    def __init__(self, size: int):
        self.size = size

    def of(self, value: np.ndarray, which: int) -> np.ndarray:
        """Hash of the window that starts at each word; a caller drops those that leave a text."""
        n = len(value) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self._bases[which].to(len(value))
        word = value if which == 0 else mix64(value ^ np.uint64(0x5851F42D4C957F2D))
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(word * up, out=total[1:])
        return mix64((total[self.size :] - total[:n]) * down[:n])


def pieces(texts: list[bytes], limit: int = BLOCK) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` bytes each; one longer text is a slice of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))

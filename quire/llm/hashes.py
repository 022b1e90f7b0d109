"""Arrays of 64-bit hashes: mixing, bitmaps of hashed counts that tasks make together, and hashes of all tokens at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(first * _K1 + last * _K2)


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as steps, in as few bytes each as the longest needs."""
    steps = np.diff(numbers, prepend=0)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if steps.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"u{raw[0]}", offset=1), dtype=np.int64)


class Bitmap:
    """`bits` bits, a power of two of them, of hashes' leading bits; chunks: those of each of `parts` equal stretches."""

    def __init__(self, chunks: dict[int, bytes], parts: int, bits: int):
        none = bytes((1 << bits) // parts // 8)
        self.raw, self.shift = b"".join(chunks.get(p, none) for p in range(parts)), U(64 - bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bucket = hashes >> self.shift
        return (np.frombuffer(self.raw, np.uint8)[bucket >> U(3)] >> (bucket & U(7)).astype(np.uint8)) & 1 > 0


class Sketch:
    """Counts hashes by their leading bits, in bounded memory; rows() deals the counts, up to 255, to `parts`."""

    def __init__(self, parts: int, bits: int, most: int):
        self.parts, self.bits, self.most, self.fresh, self.size = parts, bits, most, [], 0

    def add(self, hashes: np.ndarray) -> bool:
        """Whether it is time for rows()."""
        self.fresh.append((hashes >> U(64 - self.bits)).astype(np.uint32))
        self.size += len(hashes)
        return self.size > self.most

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """part, buckets from its first on, counts."""
        if not self.size:
            return
        bucket = np.sort(np.concatenate(self.fresh))
        self.fresh, self.size = [], 0
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        n = np.minimum(np.diff(np.append(first, len(bucket))), 255).astype(np.uint8)
        bucket, width = bucket[first].astype(np.int64), (1 << self.bits) // self.parts
        cuts = np.searchsorted(bucket, np.arange(self.parts + 1) * width)
        for p in range(self.parts):
            a, b = cuts[p], cuts[p + 1]
            if b > a:
                yield p, packed(bucket[a:b] - p * width), n[a:b].tobytes()


class Sums:
    """Adds up what Sketch.rows() gave for each part."""

    def __init__(self, parts: int, bits: int):
        self.width, self.sums = (1 << bits) // parts, {}

    def add(self, key, buckets: bytes, counts: bytes) -> None:
        acc = self.sums.setdefault(key, np.zeros(self.width, np.uint8))
        at = unpacked(buckets)
        acc[at] = np.minimum(acc[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), 255)

    def bits(self, least: int) -> Iterator[tuple]:
        for key, acc in self.sums.items():
            yield key, np.packbits(acc >= least, bitorder="little").tobytes()


_LETTER = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WINDOW = 1 << 20
_powers = np.ones(1, U), np.ones(1, U)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        k = int(_K1)
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, x, U)))) for x in (k, pow(k, -1, 1 << 64)))
    return _powers


class Lines:
    """The lines of some texts and their tokens (what stands between ASCII blanks), as arrays.

    Of lines: text (number of the text), number (in it), n (tokens), first (token). Of tokens: hash, place in the
    line, line, and digit, whether it holds one.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        start, end = edge[::2], edge[1::2]
        new = np.flatnonzero(data == 10)
        per = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), per)
        self.number = np.arange(len(new)) - np.repeat(np.cumsum(per) - per, per)
        self.line = np.searchsorted(new, start)
        self.first = np.searchsorted(self.line, np.arange(len(new)))
        self.n = np.diff(np.append(self.first, len(start)))
        self.place = np.arange(len(start)) - self.first[self.line]
        digits = np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)
        self.digit = digits[end - 1] - digits[start] + ((data[start] >= 48) & (data[start] <= 57)) > 0
        self.hash = np.zeros(len(start), U)
        a = 0
        while a < len(start):  # token by token in windows, so that little is held for each byte
            b = max(a + 1, int(np.searchsorted(end, start[a] + _WINDOW, side="right")))
            begin = start[a]
            up, down = _power(end[b - 1] - begin + 1)
            sums = np.concatenate((np.zeros(1, U), np.cumsum(_LETTER[data[begin : end[b - 1]]] * up[: end[b - 1] - begin])))
            self.hash[a:b] = mix((sums[end[a:b] - begin] - sums[start[a:b] - begin]) * down[start[a:b] - begin] + (end[a:b] - start[a:b]).astype(U))
            a = b

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums of tokens' values for each line."""
        sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
        return sums[self.first + self.n] - sums[self.first]

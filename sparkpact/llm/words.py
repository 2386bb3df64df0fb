"""Vectorised hashing of words and word windows over batches of UTF-8 texts (numpy, no Python object per word)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: The separators of the operators' word rule: space and \x09-\x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but letters and digits.
NOT_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_BLOCK = 1 << 20
_LONGEST = 1 << 22
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ in all but a few low bits
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of texts: a polynomial over random byte values, taken from prefix sums, then mixed.

    fold: upper-case ASCII letters count as lower case. Separators are single bytes, so UTF-8 sequences stay whole.
    """

    def __init__(self, separators: bytes = SPACES, fold: bool = False, seed: int = 7):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        if fold:
            self.values[65:91] = self.values[97:123]
        self.values[self.sep] = 0
        self.salt = U64((seed * 0xD1B54A32D192ED03 + 1) & _MASK)
        self._grow(_BLOCK)

    def _grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.power = np.full(n + 1, _BASE, U64)
        self.inverse = np.full(n + 1, inverse, U64)
        self.power[0] = self.inverse[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.inverse = np.multiply.accumulate(self.inverse)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("power", "inverse")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._grow(_BLOCK)

    def _block(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(buf) >= len(self.power):
            self._grow(len(buf) + 1)
        gap = self.sep[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.empty(len(buf) + 1, U64)
        sums[0] = 0
        np.cumsum(self.values[buf] * self.power[: len(buf)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(hashes + (ends - starts).astype(U64) * self.salt), starts, ends

    def words(self, buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of each word of one buffer; long buffers are cut at separators."""
        data, at, parts = np.frombuffer(buf, np.uint8), 0, []
        while len(data) - at > _LONGEST:
            gaps = np.flatnonzero(self.sep[data[at : at + _LONGEST]])
            size = int(gaps[-1]) + 1 if len(gaps) else 0
            if not size:  # one word longer than a block: up to its end
                rest = np.flatnonzero(self.sep[data[at:]])
                size = int(rest[0]) + 1 if len(rest) else len(data) - at
            parts.append((at, self._block(data[at : at + size])))
            at += size
        parts.append((at, self._block(data[at:])))
        return tuple(np.concatenate([p[i] + (a if i else 0) if i else p[i] for a, p in parts]) for i in range(3))  # type: ignore[return-value]

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts in order, and where each text's begin: len(texts) + 1 offsets."""
        hashes, counts, some, size = [], [], [], 0

        def flush():
            nonlocal some, size
            if some:
                h, starts, _ = self.words(b" ".join(some))
                begins = np.cumsum([0, *(len(t) + 1 for t in some)])
                counts.append(np.diff(np.searchsorted(starts, begins)))
                hashes.append(h)
            some, size = [], 0

        for t in texts:
            t = t or b""
            if size + len(t) > _BLOCK - len(some) - 1:
                flush()
            some.append(t)
            size += len(t)
        flush()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(hashes) if hashes else np.empty(0, U64)), offsets


def rolled(h: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """The hash of each window of k consecutive entries, by doubling: about log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    have, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = have, size
            else:  # windows of `size` entries before those of `done`
                m = len(h) - size - done + 1
                out = have[:m] * U64(pow(base, done, 1 << 64)) + out[size : size + m]
                done += size
        if size * 2 > k:
            break
        have = have[: len(have) - size] * U64(pow(base, size, 1 << 64)) + have[size:]
        size *= 2
    return mix(out[:n])


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of concatenated texts: where windows of k words within one text start, and how many each text has."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - counts), counts), counts


def texts_of(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sliced(batches, column: str, most: int = 2 << 20):
    """Arrow batches in slices of about `most` bytes of text: what numpy holds at a time doesn't depend on the batch."""
    for b in batches:
        i, size = 0, 0
        sizes = [len(t or b"") for t in texts_of(b.column(column))]
        for k, n in enumerate(sizes):
            size += n
            if size >= most:
                yield b.slice(i, k + 1 - i)
                i, size = k + 1, 0
        if i < b.num_rows or not b.num_rows:
            yield b.slice(i)

"""Vectorised work on the text column of Arrow batches: bytes, words, lines and substring hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Random weight of each byte value and the odd base of the substring hash (fixed values, any would do).
_WEIGHTS = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some consecutive documents: `data` holds their UTF-8 bytes, document i spans offsets[i]:offsets[i + 1]."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def document(self, i: int) -> memoryview:
        return memoryview(self.data[self.offsets[i] : self.offsets[i + 1]])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """Document number of each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end positions of the maximal runs of bytes outside ASCII white space."""
        word = ~_SPACE[self.data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        edges = self.offsets[1:-1]
        before[edges[edges < len(word)]] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        inner = edges[edges > 0]
        after[inner - 1] = False
        return starts, np.flatnonzero(word & ~after) + 1

    def hasher(self) -> SubstringHash:
        return SubstringHash(self.data)

    def word_digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of a cryptographic digest of each document's words joined by one blank; 0, 0 without a word."""
        keep = ~_SPACE[self.data]
        spaced = self.data.copy()
        between = ends[:-1][self.doc_of(starts[:-1]) == self.doc_of(starts[1:])] if len(starts) else ends
        keep[between], spaced[between] = True, 0x20
        borders = np.concatenate([[0], np.cumsum(keep)])[self.offsets].tolist()
        joined = spaced[keep].data
        out = np.zeros((2, len(self)), dtype=np.uint64)
        for i, (a, b) in enumerate(zip(borders, borders[1:])):
            if b > a:
                out[:, i] = np.frombuffer(hashlib.blake2b(joined[a:b], digest_size=16).digest(), dtype="<u8")
        return out


class SubstringHash:
    """64-bit hashes of byte ranges from prefix sums of weight * base**position (mod 2**64).

    Made for windows of some dozens of bytes: texts of 1024 bytes and more can be built to collide.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._inverse = _powers(_BASE_INVERSE, n + 1)
        self._prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_WEIGHTS[data] * _powers(_BASE, n + 1)[:n], dtype=np.uint64, out=self._prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every range of `width` bytes."""
        n = len(self._prefix) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._prefix[width:] - self._prefix[:n]) * self._inverse[:n])


#: A 64-bit number's low 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Ranges of more bytes go through a cryptographic digest.
_CHAINED = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; behind the end stand zeros."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))


def low_bytes(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """`words` with all but the first 0 to 8 bytes (`count`, cut to that range) cleared."""
    return words & _LOW[np.clip(count, 0, 8)]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 50) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step through a non-linear finaliser.

    No structure of a text makes two ranges collide, and ranges of one length up to eight bytes
    never do; where a result hangs on equality, the bytes are compared as well (`same_ranges`).
    """
    at, lens = eights(data), ends - starts
    out = mix(mix(lens.astype(np.uint64) + np.uint64(seed)) ^ low_bytes(at[starts], lens))
    rest, step = np.flatnonzero((lens > 8) & (lens <= _CHAINED)), 8
    while len(rest):
        out[rest] = mix(out[rest] ^ low_bytes(at[starts[rest] + step], lens[rest] - step))
        step += 8
        rest = rest[lens[rest] > step]
    for i in np.flatnonzero(lens > _CHAINED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed % 256])).digest(), "little")
    return out


def same_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each range holds the same bytes as its partner."""
    at, lens = eights(data), ends - starts
    out = lens == other_ends - others
    rest, step = np.flatnonzero(out), 0
    while len(rest) and step < _CHAINED:
        left = lens[rest] - step
        out[rest] = low_bytes(at[starts[rest] + step], left) == low_bytes(at[others[rest] + step], left)
        step += 8
        rest = rest[out[rest] & (lens[rest] > step)]
    for i in rest.tolist():
        out[i] = np.array_equal(data[starts[i] + step : ends[i]], data[others[i] + step : other_ends[i]])
    return out


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string column in blocks of bounded size; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1)
        last = min(last, n)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenation of the ranges starts[i] : starts[i] + lengths[i]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def binary_rows(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the next lengths[i] items of `values` as raw bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int64)
    raw = np.ascontiguousarray(values)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(raw.view(np.uint8).data if len(raw) else b"")])
    return array.cast(pa.binary())

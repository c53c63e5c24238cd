"""Vectorised words, hashes and shingles over the byte buffers of Arrow string columns.

All word patterns of this subpackage separate at ASCII bytes only, and no byte
of a longer UTF-8 character is ASCII, so they can be evaluated on bytes.
Nothing here builds a Python string for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in slices of about this many bytes; a longer text is one slice.
SLICE_BYTES = 1 << 20

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
#: Words [^\x20\x09-\x0D]+
SPACED = ~_GAPS
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
ALNUM = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A for c in range(256)])
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = np.random.default_rng(977).integers(1, 2**64 - 1, 64, dtype=U64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """base**i and its inverse modulo 2**64, as far as any slice has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES * 2)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                x = np.full(n, base, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = _Powers()


class Texts:
    """A slice of a string column: lower-cased or plain bytes and the bounds of each text."""

    __slots__ = ("data", "bounds", "valid")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray):
        self.data, self.bounds, self.valid = data, bounds, valid

    def __len__(self) -> int:
        return len(self.bounds) - 1


def buffers(column: pa.Array) -> Texts:
    """The bytes and bounds of a string (or binary) array; nulls are empty and not valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, _, (_, offs, data) = len(column), None, column.buffers()
    valid = ~np.asarray(column.is_null()) if column.null_count else np.ones(n, bool)
    if offs is None or n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid)
    bounds = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:  # the bytes below a null are not defined
        lengths = np.where(valid, np.diff(bounds), 0)
        if int(lengths.sum()) != int(bounds[-1] - bounds[0]):
            return buffers(pa.array([x if ok else "" for x, ok in zip(column.to_pylist(), valid)], pa.string()))
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[bounds[0] : bounds[-1]], bounds - bounds[0], valid)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one longer text."""
    whole = buffers(batch.column(column))
    at, n = 0, len(whole)
    while at < n:
        end = int(np.searchsorted(whole.bounds, whole.bounds[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        a, b = whole.bounds[at], whole.bounds[end]
        yield batch.slice(at, end - at), Texts(whole.data[a:b], whole.bounds[at : end + 1] - a, whole.valid[at:end])
        at = end


class Words:
    """Start and end bytes of all words of a slice, and each text's range among them."""

    __slots__ = ("texts", "data", "starts", "ends", "bounds")

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool):
        data = LOWER[texts.data] if lower else texts.data
        inside = table[data]
        n = len(data)
        edges = np.unique(texts.bounds)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edges[edges < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.texts, self.data = texts, data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, texts.bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, wherever it stands."""
        up, down = _POWERS.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h ^ (self.ends - self.starts).astype(U64))

    def owner(self) -> np.ndarray:
        """Each word's text, as its row in the slice."""
        return np.repeat(np.arange(len(self.texts)), self.counts())


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; the caller drops runs that cross two texts."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    total = np.full(len(hashes) - k + 1, k, U64)
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * _STEPS[j]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash, as an array of length 1, of a whole short word sequence."""
    return windows(hashes, len(hashes))


def hash_word(word: bytes) -> int:
    """The hash that :meth:`Words.hashes` gives a single word; for tests and small tables."""
    texts = Texts(np.frombuffer(word, np.uint8), np.array([0, len(word)]), np.ones(1, bool))
    w = Words(texts, np.ones(256, bool), False)
    return int(w.hashes()[0])

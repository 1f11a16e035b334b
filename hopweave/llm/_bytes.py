"""Vectorised byte-level text handling shared by the Arrow-batch operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (int(n) - 1).bit_length()
        for k, x in enumerate((BASE, INVERSE)):
            p = np.full(size, x, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows per Arrow batch from here on: few where whole texts travel, so that a worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: Bytes of rows that a worker passes between two times that it gives memory back.
PASSED = 8 << 20
_passed = 0


def trimmed(run):
    """run, a task's function over Arrow batches, with memory given back to the system when a task ends: workers are reused. Tasks of few rows add up to PASSED before."""

    def counted(batches):
        global _passed
        for batch in batches:
            _passed += batch.nbytes
            yield batch

    def wrapped(batches):
        global _passed
        try:
            yield from counted(run(counted(batches)))
        finally:
            if _passed >= PASSED:
                _passed = 0
                gc.collect()
                pa.default_memory_pool().release_unused()
                with contextlib.suppress(OSError, AttributeError):
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A string column as one binary array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, end row, bytes, offsets from 0. A longer text is a run of its own."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = sum of (byte + 1) * BASE**i over s <= i < e."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A position-free hash of each span start..end, from a prefix hash."""
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start])


class WordHashes(dict):
    """Keyed 64-bit BLAKE2b of words, kept for the ones seen first; a polynomial hash has texts that collide for any base."""

    KEPT, LONGEST = 200_000, 64

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"words").digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """The hashes of the words of text, runs of bytes other than blank and 0x09-0x0D, with A-Z in lower case."""
        return np.array(list(map(self.__getitem__, text.lower().split())), U64)

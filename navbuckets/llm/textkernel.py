"""Batch text kernels: words and word hashes of a whole Arrow batch with a few numpy passes.

Everything here works on one bounded batch inside a task: a batch is cut into *pieces* of
at most ``PIECE_BYTES`` of text (a single longer text is a piece of its own), so the memory
of a task follows the piece size, or the longest single text, never the partition.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21
_LIBC = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
_LIBC = _LIBC if hasattr(_LIBC, "malloc_trim") else None
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_class(separators) -> np.ndarray:
    """256 flags: is this byte part of a word (bytes of non-ASCII characters always are)."""
    flags = np.ones(256, bool)
    flags[np.frombuffer(bytes(separators), np.uint8)] = False
    return flags


#: fixed values: the two word rules, as the separator characters
ALNUM_WORDS = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SPACE_WORDS = byte_class([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and what an earlier stage left in
    their arenas would count beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES):
    """Zero-copy slices of a batch with at most ``limit`` text bytes (or one longer row)."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


class Words:
    """Words of several texts: byte spans, 64-bit hashes, and the word range of each text.

    ``prefixes``: lengths in bytes; ``prefix[k]`` are the hashes of the words' first k bytes
    (0 for words that are not longer).
    """

    __slots__ = ("starts", "ends", "hashes", "first", "prefix")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word_byte: np.ndarray, prefixes=()):
        low = LOWER[data]
        inside = is_word_byte[low]
        if not is_word_byte[65]:  # capitals are lower-cased before the rule applies
            inside = is_word_byte[97] & ((data >= 65) & (data <= 90)) | inside
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begin[heads] = inside[heads]
        self.starts = np.flatnonzero(begin)
        kept = low[inside]
        rank = np.cumsum(inside)  # word bytes so far
        at = rank[self.starts] - 1  # index of each word's first byte among the word bytes
        lengths = np.diff(np.append(at, len(kept)))
        self.ends = self.starts + lengths
        self.first = np.searchsorted(self.starts, offsets)
        self.prefix = {k: np.zeros(len(at), np.uint64) for k in prefixes}
        if len(at):
            powers = np.ones(int(lengths.max()) + 1, np.uint64)
            powers[1:] = _MULT
            powers = np.multiply.accumulate(powers)
            place = np.arange(len(kept)) - np.repeat(at, lengths)
            value = (kept.astype(np.uint64) + np.uint64(1)) * powers[place]
            self.hashes = mix(np.add.reduceat(value, at))
            for k in prefixes:
                head = mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), at) + np.uint64(k << 56))
                self.prefix[k] = np.where(lengths > k, head, np.uint64(0))
        else:
            self.hashes = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective), so that low bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class HashTable:
    """Exact lookup of 64-bit hashes in a small sorted set: a direct table on the low bits
    skips most keys, a binary search settles the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.uint64))
        self.mask = np.uint64((1 << max(10, len(self.keys).bit_length() + 4)) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in ``keys``, -1 if absent."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            some = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
            at = np.searchsorted(self.keys, hashes[some])
            at[at == len(self.keys)] = 0
            same = self.keys[at] == hashes[some]
            out[some[same]] = at[same]
        return out


def sha256_hex(data) -> str:
    return hashlib.sha256(data).hexdigest()

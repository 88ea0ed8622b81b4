"""Vectorised word and shingle hashing of Arrow string batches.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased. Everything works on the bytes of a batch
at once: a word costs a few array operations, whatever its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; working arrays are a small multiple of it
CHUNK_BYTES = 4 << 20
#: longer words are hashed one by one
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def string_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, row offsets into them) for stretches of about ``CHUNK_BYTES``; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield row, last - row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more entry than rows)."""
    solid = np.empty(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[solid[cuts] & solid[cuts + 1]]  # a row ends and the next begins inside a run of word bytes
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]), kind="stable")
    starts, ends = marks[0::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, eight bytes at a time."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[:len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64))
    long_words = np.flatnonzero(lengths > LONG_WORD)
    live = np.flatnonzero(lengths <= LONG_WORD) if len(long_words) else None
    at = 0
    while True:
        if live is None:
            left, where = lengths, starts
            h = mix(h ^ (eight[where] & _MASKS[np.minimum(left, 8)]))
            live = np.flatnonzero(lengths > 8)
        else:
            if not len(live):
                break
            left = lengths[live] - at
            h[live] = mix(h[live] ^ (eight[starts[live] + at] & _MASKS[np.minimum(left, 8)]))
            live = live[left > 8]
        at += 8
    for i in long_words:
        digest = hashlib.blake2b(padded[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    return h


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of its ``width``-word shingles) for every row.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    factor = np.uint64(0xD6E8FEB86659FD93)
    none = np.zeros(0, np.uint64)
    for first, count, data, offsets in string_chunks(column):
        starts, ends, words = word_bounds(data, offsets)
        h = word_hashes(data, starts, ends)
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width if len(rolled) else 0):  # a stretch may have fewer words than a shingle
            rolled = rolled * factor + h[j:len(h) - width + 1 + j]
        rolled = mix(rolled + np.uint64(width))
        for i in range(count):
            lo, hi = words[i], words[i + 1]
            if hi - lo >= width:
                part = np.sort(rolled[lo:hi - width + 1])
                fresh = np.empty(len(part), bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                yield first + i, part[fresh]
            elif hi > lo:
                value = np.zeros(1, np.uint64)
                for x in h[lo:hi]:
                    value = value * factor + x
                yield first + i, mix(value + np.uint64(hi - lo))
            else:
                yield first + i, none

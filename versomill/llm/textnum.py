"""Words, lines and hashes of whole Arrow batches, in numpy.

A batch of texts is one byte array with offsets.  Word borders come from a table
over bytes: both word classes in use treat every byte of a multi-byte UTF-8
character alike, so bytes decide.  A range's hash takes eight bytes at a time, each
multiplied, rotated and mixed into the state (all ranges side by side), and ranges of
more than LONG bytes go through xxh3; ``same_bytes`` compares ranges themselves, for
results that must not rest on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_STEP = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
#: Bytes up to which ranges are hashed and compared side by side.
LONG = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    h ^= h >> U(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    buf, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them (one more at the end)."""
    n = len(buf)
    w = np.zeros(n + 1, bool)
    w[:n] = kind[buf]
    first = np.empty(n + 1, bool)
    first[0] = w[0]
    np.greater(w[1:], w[:-1], out=first[1:])
    border = offs[(offs > 0) & (offs < n)]  # a word never crosses from one text into the next
    first[border] = w[border]
    last = np.empty(n + 1, bool)
    last[0] = False
    np.greater(w[:-1], w[1:], out=last[1:])
    last[border] |= w[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offs)


class Ranges:
    """Hashes and comparisons of byte ranges of one piece, with A-Z in lower case if wanted."""

    def __init__(self, buf: np.ndarray, lower: bool):
        n = len(buf)
        self.bytes = np.zeros(n + 8, np.uint8)
        self.bytes[:n] = LOWER[buf] if lower else buf
        #: the eight bytes from each place on
        self.eight = np.ndarray((n + 1,), "<u8", self.bytes, strides=(1,))

    def _chunk(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self.eight[starts] & _KEEP[np.minimum(left, 8)]

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each range; other seeds give independent ones."""
        size = (ends - starts).astype(np.int64)
        h = mix(size.astype(np.uint64) + U((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1)))
        todo, at, left = slice(None), starts, size
        long = size > LONG
        if long.any():
            whole = memoryview(self.bytes)
            for k in np.flatnonzero(long).tolist():
                h[k] = xxhash.xxh3_64_intdigest(whole[starts[k] : ends[k]], seed=seed)
            todo = np.flatnonzero(~long)
            at, left = starts[todo], size[todo]
        step = 0
        while len(at):
            x = self._chunk(at, left) * _STEP[step % 5]
            x ^= x >> U(32)
            state = (h[todo] ^ x) * U(0x9FB21C651E98DF25)
            h[todo] = state ^ (state >> U(29))
            more = np.flatnonzero(left > 8)
            todo = more if isinstance(todo, slice) else todo[more]
            at, left, step = at[more] + 8, left[more] - 8, step + 1
        return mix(h)

    def same_bytes(self, starts: np.ndarray, ends: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
        """Whether each range equals the other one of its place, byte by byte."""
        size = ends - starts
        same = size == ends2 - starts2
        for k in np.flatnonzero(same & (size > LONG)).tolist():
            same[k] = np.array_equal(self.bytes[starts[k] : ends[k]], self.bytes[starts2[k] : ends2[k]])
        todo = np.flatnonzero(same & (size <= LONG) & (size > 0))
        at, at2, left = starts[todo], starts2[todo], size[todo]
        while len(todo):
            equal = self._chunk(at, left) == self._chunk(at2, left)
            same[todo[~equal]] = False
            more = np.flatnonzero(equal & (left > 8))
            todo, at, at2, left = todo[more], at[more] + 8, at2[more] + 8, left[more] - 8
        return same


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    return Ranges(buf, lower).of(starts, ends, seed)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; one for each possible start."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += (h[j : j + n] ^ (h[j : j + n] >> U(31))) * _STEP[j % 5] + U(j + 1)
        out = (out << U(7)) | (out >> U(57))
    return mix(out)


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a mask over each text."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text number of each word, from where texts' words begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class Lookup:
    """Positions of sorted 64-bit keys, by a directory of their top 20 bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.start = np.searchsorted(keys, np.arange(1 << 20, dtype=np.uint64) << U(44)).astype(np.int32)
        self.most = int(np.diff(np.append(self.start, len(keys))).max(initial=0))

    def of(self, h: np.ndarray) -> np.ndarray:
        """-1 for what is no key."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        todo = np.arange(len(h))
        at = self.start[(h >> U(44)).astype(np.int64)].astype(np.int64)
        for _ in range(self.most):
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            key = self.keys[at]
            here = key == h[todo]
            out[todo[here]] = at[here]
            more = key < h[todo]
            todo, at = todo[more], at[more] + 1
            if not len(todo):
                break
        return out

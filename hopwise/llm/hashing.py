"""Vectorised hashing of words and word windows in whole Arrow batches of texts.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which never occur inside a multi-byte UTF-8 character.
A word of up to LONG bytes is hashed by mixing in its eight-byte blocks one after another, so words of up to eight bytes never
share a hash with others of their length; longer words are hashed by BLAKE2b. Sequences are hashed by mixing pairs of
neighbours, then pairs of pairs and so on: any sequence is covered by two runs whose length is a power of two. No
step is a sum or a polynomial, so patterned words and texts collide no more than others, with a chance of 2**-64 a pair;
the second hash of a word shares nothing with the first, and with both the chance is 2**-128.
"""

from __future__ import annotations

import copy
import hashlib

import numpy as np

U = np.uint64
CHUNK = 1 << 19
LONG, CACHED_LEVELS = 64, 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
_ODD = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_SEED = (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))
_LENGTH, _PAIR = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, second: bool = False) -> np.ndarray:
    length = (stop - start).astype(np.int64)
    odd = _ODD[second]
    h = mix(_SEED[second] ^ length.astype(U) * odd)
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    at = np.flatnonzero(length <= LONG)
    for j in range(0, LONG, 8):
        at = at[length[at] > j]
        if not len(at):
            break
        h[at] = mix(h[at] * odd ^ (blocks[start[at] + j] & _MASKS[np.minimum(length[at] - j, 8)]))
    for i in np.flatnonzero(length > LONG):
        digest = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=16).digest()
        h[i] = np.frombuffer(digest, U)[int(second)]
    return h


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of each pair, one-to-one in either part."""
    return mix(x * _PAIR ^ y)


class Words:
    """The words of some texts, one after another: hash, length in bytes, byte span; doc i has words first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, fold: bool = False):
        """data: the texts' bytes; ends: offsets, one more than texts, from 0. fold: A-Z count as a-z."""
        n = len(data)
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        solid = ~_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = ends[:-1][(ends[:-1] < n) & (ends[:-1] < ends[1:])]
        begins[inner] = solid[inner]
        self.start = np.flatnonzero(begins)
        stop = np.zeros(n + 1, bool)
        stop[1:] = solid
        stop[1:n] &= ~solid[1:]
        last = ends[1:][ends[1:] > 0]
        stop[last] = solid[last - 1] if n else False
        self.stop = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, ends)
        self.hash = word_hashes(data, self.start, self.stop)
        self._levels: dict[tuple[int, bool], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def rehashed(self, hashes: np.ndarray) -> Words:
        """The same words with other hashes."""
        out = copy.copy(self)
        out.hash, out._levels = hashes, {}
        return out

    def level(self, j: int, second: bool = False) -> np.ndarray:
        """Hashes of all runs of 2**j words."""
        have = self._levels.get((j, second))
        if have is None:
            if j == 0:
                have = word_hashes(self.data, self.start, self.stop, True) if second else self.hash
            else:
                less, half = self.level(j - 1, second), 1 << (j - 1)
                have = paired(less[: max(len(less) - half, 0)], less[half:])
            if j <= CACHED_LEVELS:
                self._levels[j, second] = have
        return have

    def spans(self, begin: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        """Hash of the word sequences begin to end (exclusive), none of them empty; second: an independent one."""
        n = end - begin
        out = np.zeros(len(begin), U)
        kind = np.frexp(n.astype(float))[1] - 1
        runs = None
        for j in range(int(kind.max(initial=-1)) + 1):
            if j <= CACHED_LEVELS:
                runs = self.level(j, second)
            else:
                half = 1 << (j - 1)
                runs = paired(runs[: max(len(runs) - half, 0)], runs[half:])
            at = np.flatnonzero(kind == j)
            if len(at):
                out[at] = paired(runs[begin[at]] ^ n[at].astype(U) * _LENGTH, runs[end[at] - (1 << j)])
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of k words that lie in one text, and their hashes."""
        if len(self) < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(doc[: len(self) - k + 1] == doc[k - 1 :])
        j = k.bit_length() - 1
        runs = self.level(j)
        return at, paired(runs[at] ^ np.full(1, k, U) * _LENGTH, runs[at + (k - (1 << j))])


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, fold: bool = False):
    """(first row, Words) over runs of rows of about CHUNK bytes; a text is never cut."""
    data, ends = text_buffers(column)
    row, n = 0, len(ends) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        yield row, Words(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], fold)
        row = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

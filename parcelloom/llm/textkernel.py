"""Vectorised word scanning of Arrow string columns with NumPy.

The kernels here read the UTF-8 buffers of an Arrow batch directly, so no Python string is made
for a text.  Work is cut into pieces of about ``PIECE`` bytes; a text longer than that is cut at
separators, so memory is bounded by the piece size, the word hashes of the longest text
(8 bytes a word) and the longest single word.

Words and lines are compared by 64-bit fingerprints: the length and then eight bytes at a time are added to a
state that is scrambled in between; spans of more than ``VECTOR`` bytes are hashed by XXH3.  No value is linear in
the bytes, so no texts collide by their structure, whatever their letters.  Runs of words are folded the same way.
A fingerprint with another seed is independent, and ``same_bytes`` compares spans themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 128 << 10
#: Most texts of a group, so that a text's number fits beside 52 bits of a fingerprint.
TEXTS = 4096
_SET_BITS, _SET_MASK = np.uint64(52), np.uint64((1 << 52) - 1)
#: Longest span, in bytes, that is hashed and compared by array operations.
VECTOR = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, with zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of the bytes of each span."""
    size = ends - starts
    value = size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    at, use = _eights(data), None
    value = mix64(value)
    value ^= at[starts] & _KEEP[np.minimum(size, 8)]
    value = mix64(value)
    for lo in range(8, VECTOR, 8):
        use = np.flatnonzero(size > lo) if use is None else use[size[use] > lo]
        if not len(use):
            return value
        value[use] = mix64(value[use] ^ (at[starts[use] + lo] & _KEEP[np.minimum(size[use] - lo, 8)]))
    raw = memoryview(data)
    for i in np.flatnonzero(size > VECTOR).tolist():
        value[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed)
    return value


def same_bytes(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each span of ``one`` holds the bytes of its counterpart in ``two``."""
    size = ends - starts
    same = size == sizes
    a, b = _eights(one), _eights(two)
    use = np.flatnonzero(same)
    for lo in range(0, VECTOR, 8):
        use = use[size[use] > lo]
        if not len(use):
            return same
        same[use] = (a[starts[use] + lo] ^ b[begins[use] + lo]) & _KEEP[np.minimum(size[use] - lo, 8)] == 0
        use = use[same[use]]
    for i in use[size[use] > VECTOR].tolist():
        same[i] = one[starts[i] : ends[i]].tobytes() == two[begins[i] : begins[i] + sizes[i]].tobytes()
    return same


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in separators:
        table[lo : hi + 1] = False
    return table


#: Bytes that belong to words ``[^\x20\x09-\x0D]+``.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes that belong to words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Bytes that belong to a line.
LINED = _class([(0x0A, 0x0A)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of the texts ``lo`` to ``hi`` (exclusive) of a batch, in order."""

    lo: int
    hi: int
    doc: np.ndarray  # int64: number of the text from 0 for ``lo``
    hash: np.ndarray  # uint64
    start: np.ndarray  # int64: byte position in ``data``
    end: np.ndarray
    data: np.ndarray  # uint8: the bytes of these texts
    offsets: np.ndarray  # int64: where each text begins in ``data``, and the end

    @property
    def texts(self) -> int:
        return self.hi - self.lo

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)

    def first(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _scan(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; no word crosses a value of ``bounds``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = False, inside
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n + 1, dtype=bool)
    after[:n], after[n] = inside, False
    after[bounds] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return span_hashes(_LOWER[data] if lower else data, starts, ends, seed), starts, ends


def _long(data: np.ndarray, table: np.ndarray, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_scan`` of one long text by pieces that end at separators."""
    parts, at = [], 0
    none = np.zeros(0, np.int64)
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):
            gaps = np.flatnonzero(~table[data[max(at, to - 65536) : to]])
            if len(gaps):
                to = max(at, to - 65536) + int(gaps[-1]) + 1
                break
            to = min(to + 65536, len(data))
        h, s, e = _scan(data[at:to], none, table, lower, seed)
        parts.append((h, s + at, e + at))
        at = to
    if not parts:
        return np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def words(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, seed: int = 0) -> Iterator[Words]:
    """The words of every text of a column, a group of texts at a time."""
    data, offsets = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        hi = min(hi, n, lo + TEXTS)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi == lo + 1 and len(part) > PIECE:
            h, s, e = _long(part, table, lower, seed)
        else:
            h, s, e = _scan(part, at, table, lower, seed)
        # a text's words lie between the first start at or after its offset and the next text's
        doc = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(s, at)))
        yield Words(lo, hi, doc, h, s, e, part, at)
        lo = hi


def all_words(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a whole column's words, each word's text, and where each text's words begin (and the end)."""
    parts = [(w.hash, w.doc + w.lo, w.counts()) for w in words(column, table, lower, seed)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    h, doc, counts = (np.concatenate(x) for x in zip(*parts))
    return h, doc, np.concatenate([[0], np.cumsum(counts)])


def word_counts(column: pa.Array, table: np.ndarray = SPACED) -> np.ndarray:
    """The number of words of every text of a column."""
    data, offsets = string_buffers(column)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for lo in range(0, len(data), PIECE):
        piece = table[data[lo : lo + PIECE]]
        new = piece.copy()
        new[1:] &= ~piece[:-1]
        if lo and table[data[lo - 1]]:
            new[0] = False
        a, b = np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, lo + len(piece), "left")
        begins = offsets[a:b] - lo  # texts may begin amid what looks like a word
        new[begins] = piece[begins]
        starts = np.flatnonzero(new) + lo
        first, last = max(0, int(np.searchsorted(offsets, lo, "right")) - 1), min(b, len(out))
        edges = np.searchsorted(starts, offsets[first : last + 1])
        edges[0] = 0
        out[first:last] += np.diff(edges)
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the ``len(hashes) - k + 1`` runs of ``k`` values."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    value = hashes[: n - k + 1].copy()
    for j in range(1, k):
        value ^= value >> np.uint64(32)
        value *= _M1
        value += hashes[j : n - k + 1 + j]
    return mix64(value + np.uint64(k))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the windows of ``k`` words within one text, and where they begin."""
    if len(w.doc) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: len(w.doc) - k + 1] == w.doc[k - 1 :])
    return shingles(w.hash, k)[at], at


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """For equally sorted keys, whether each row differs from the one before."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the lines that hold a word, in order; for words of ``SPACED`` as written."""
    if w.texts == 1 and len(w.data) > PIECE:
        h, start, end = _long(w.data, LINED, False)
    else:
        bounds = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate([w.offsets[:-1], bounds + 1]))
        end = np.sort(np.concatenate([bounds, w.offsets[1:]]))
        some = end > start
        start, end = start[some], end[some]
        h = span_hashes(w.data, start, end)
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    h, start = h[has], start[has]
    return np.searchsorted(w.offsets, start, "right") - 1, h


def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each value is found more than once in its text."""
    packed = doc.astype(np.uint64) << _SET_BITS | h >> np.uint64(12)
    ordered = np.sort(packed)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(len(h), dtype=bool)
    return again[np.minimum(np.searchsorted(again, packed), len(again) - 1)] == packed


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of ``n`` words the windows of ``k`` words that begin at ``at`` cover."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def byte_classes(w: Words, table: np.ndarray, classes: int) -> np.ndarray:
    """How many bytes of each class each text has."""
    out = np.zeros((w.texts, classes), dtype=np.int64)
    if w.texts == 1:
        for lo in range(0, len(w.data), PIECE):
            out[0] += np.bincount(table[w.data[lo : lo + PIECE]], minlength=classes)
        return out
    where = np.repeat(np.arange(w.texts, dtype=np.int32) * classes, np.diff(w.offsets))
    return np.bincount(where + table[w.data], minlength=w.texts * classes).reshape(w.texts, classes)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``k`` words (52 bits), sorted within the text, and where each text's begin.

    A text of fewer than ``k`` words, but not none, has its whole sequence as its one shingle.
    """
    h, at = windows(w, k)
    doc = w.doc[at]
    counts, first = w.counts(), w.first()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([shingles(w.hash[first[d] : first[d + 1]], int(counts[d]))[0] for d in short], dtype=np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    packed = np.sort(doc.astype(np.uint64) << _SET_BITS | h >> np.uint64(12))
    packed = packed[first_of_runs(packed)]
    bounds = np.searchsorted(packed, np.arange(w.texts, dtype=np.uint64) << _SET_BITS)
    return packed & _SET_MASK, np.append(bounds, len(packed))

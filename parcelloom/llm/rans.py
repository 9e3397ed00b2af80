"""Static range asymmetric numeral systems over token ids, vectorised with NumPy.

A segment has one frequency table, shared by its blocks.  A block is coded independently of the others by
``lanes`` interleaved coders that write 32-bit words to one stream; its checkpoint holds the words' place
and number, the tokens' number, the coders' final states and a CRC-32 of the words.  Any blocks can be
decoded alone or side by side.  ``TOGETHER`` blocks are coded and decoded at the same time, one array operation
for a step of all their lanes.

Layout, little-endian: magic, u32 header length, header (JSON), then the sections it names in order:
symbols u32, frequencies u32, checkpoints, states u64, documents' ids i64, documents' token counts u32,
words u32.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

MAGIC = b"PLRANS01"
LANES, STEPS = 64, 1024
#: Blocks that are coded and decoded by the same array operations.
TOGETHER = 16
#: States lie in [2**31, 2**63).
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_CHECK = np.dtype([("at", "<u8"), ("words", "<u4"), ("tokens", "<u4"), ("crc", "<u4")])


class CorruptSegment(ValueError):
    """A segment's checksum or layout does not hold."""


def frequency_table(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The symbols in use, frequencies of at least 1 that add up to ``2**scale``, and the scale.

    The scale is 16, or more where a quarter of the range is too small for the symbols.
    """
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    scale = max(16, len(symbols).bit_length() + 2)
    if scale > 28:
        raise ValueError("too many different tokens for a segment")
    counts = counts[symbols]
    spare = (1 << scale) - len(symbols)
    frequency = 1 + counts * spare // max(1, int(counts.sum()))
    if len(symbols):
        frequency[int(counts.argmax())] += (1 << scale) - int(frequency.sum())
    return symbols.astype(np.uint32), frequency.astype(np.uint32), scale


def _code(coded: np.ndarray, frequency: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final states, words and numbers of words of blocks of symbol numbers (block, step, lane)."""
    blocks, steps, _ = coded.shape
    # a step of all lanes of the blocks is a row
    coded = np.ascontiguousarray(coded.transpose(1, 0, 2)).reshape(steps, blocks * LANES)
    f64 = frequency.astype(np.uint64)
    below = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f64)[:-1]])
    limit = f64 << np.uint64(63 - scale)
    x = np.full(blocks * LANES, _LOW, dtype=np.uint64)
    out = np.zeros((steps, blocks * LANES), dtype=np.uint32)
    wrote = np.zeros((steps, blocks * LANES), dtype=bool)
    for t in range(steps - 1, -1, -1):
        s = coded[t]
        full = x >= limit[s]
        wrote[t] = full
        out[t] = x.astype(np.uint32)
        np.right_shift(x, _WORD, out=x, where=full)
        f = f64[s]
        q = x // f
        x = (q << np.uint64(scale)) + (x - q * f) + below[s]
    # in the order of decoding: block, step, lane
    wrote = wrote.reshape(steps, blocks, LANES).transpose(1, 0, 2)
    return x.reshape(blocks, LANES), out.reshape(steps, blocks, LANES).transpose(1, 0, 2)[wrote], wrote.reshape(blocks, -1).sum(axis=1)


def encode(tokens: np.ndarray, doc_ids: np.ndarray, doc_tokens: np.ndarray) -> bytes:
    """A segment of ``tokens``, which are those of the documents one after another."""
    symbols, frequency, scale = frequency_table(tokens)
    n = len(tokens)
    steps = min(STEPS, max(1, -(-n // LANES)))
    block = steps * LANES
    blocks = -(-n // block)
    checks, states, stream = np.zeros(blocks, _CHECK), np.zeros((blocks, LANES), np.uint64), np.zeros(0, np.uint32)
    if n:
        place = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
        place[symbols] = np.arange(len(symbols))
        coded = np.full(blocks * block, int(frequency.argmax()), dtype=np.int32)
        coded[:n] = place[tokens]
        found = [_code(coded[at * block : (at + TOGETHER) * block].reshape(-1, steps, LANES), frequency, scale) for at in range(0, blocks, TOGETHER)]
        states = np.concatenate([x for x, _, _ in found])
        stream = np.concatenate([x for _, x, _ in found])
        checks["words"] = np.concatenate([x for _, _, x in found])
        checks["at"] = np.concatenate([[0], np.cumsum(checks["words"])[:-1]])
        checks["tokens"] = block
        checks["tokens"][-1] = n - (blocks - 1) * block
        for b in checks:
            b["crc"] = zlib.crc32(stream[int(b["at"]) : int(b["at"]) + int(b["words"])].astype("<u4").tobytes())
    parts = [symbols.astype("<u4").tobytes(), frequency.astype("<u4").tobytes(), checks.tobytes(), states.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), doc_tokens.astype("<u4").tobytes(), stream.astype("<u4").tobytes()]
    header = json.dumps({"scale": scale, "lanes": LANES, "steps": steps, "blocks": blocks, "tokens": n, "sizes": [len(p) for p in parts], "crc": [zlib.crc32(p) for p in parts[:-1]]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts])


class Segment:
    """A segment read from bytes; tables and checkpoints are verified at once, blocks as they are decoded."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise CorruptSegment("not a segment")
        size = int.from_bytes(raw[8:12], "little")
        self.header = json.loads(raw[12 : 12 + size])
        at, parts = 12 + size, []
        for n in self.header["sizes"]:
            parts.append(raw[at : at + n])
            at += n
        if at != len(raw) or any(zlib.crc32(p) != c for p, c in zip(parts, self.header["crc"])):
            raise CorruptSegment("a table's checksum does not hold")
        self.symbols, self.frequency = np.frombuffer(parts[0], "<u4"), np.frombuffer(parts[1], "<u4")
        self.checks = np.frombuffer(parts[2], _CHECK)
        self.states = np.frombuffer(parts[3], "<u8").reshape(-1, self.header["lanes"])
        self.doc_ids, self.doc_tokens = np.frombuffer(parts[4], "<i8"), np.frombuffer(parts[5], "<u4")
        self.words = np.frombuffer(parts[6], "<u4")

    def decode(self, blocks: range | None = None) -> np.ndarray:
        """The tokens of some blocks (a range of step 1), or of all."""
        blocks = range(self.header["blocks"]) if blocks is None else blocks
        n = len(blocks)
        if not n:
            return np.zeros(0, np.uint32)
        if n > TOGETHER:
            return np.concatenate([self.decode(blocks[at : at + TOGETHER]) for at in range(0, n, TOGETHER)])
        checks = self.checks[blocks.start : blocks.stop]
        for b in checks:
            if zlib.crc32(self.words[int(b["at"]) : int(b["at"]) + int(b["words"])].tobytes()) != b["crc"]:
                raise CorruptSegment("a block's checksum does not hold")
        scale, lanes, steps = self.header["scale"], self.header["lanes"], self.header["steps"]
        f64 = self.frequency.astype(np.uint64)
        below = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f64)[:-1]])
        of_slot = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.frequency)
        x = self.states[blocks.start : blocks.stop].astype(np.uint64).ravel()
        at = checks["at"].astype(np.int64)
        words = np.append(self.words, np.uint32(0))
        out = np.empty((steps, n * lanes), dtype=np.int32)
        mask = np.uint64((1 << scale) - 1)
        for t in range(steps):
            slot = (x & mask).astype(np.int64)
            s = of_slot[slot]
            out[t] = s
            x >>= np.uint64(scale)
            x *= f64[s]
            x += slot.astype(np.uint64) - below[s]
            need = x < _LOW
            i = np.flatnonzero(need)
            if len(i):
                block = i // lanes
                number = np.bincount(block, minlength=n)
                rank = np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number)
                x[i] = x[i] << _WORD | words[at[block] + rank].astype(np.uint64)
                at += number
        if not np.array_equal(at, checks["at"].astype(np.int64) + checks["words"]) or not (x == _LOW).all():
            raise CorruptSegment("a block does not end where it should")
        tokens = self.symbols[out.reshape(steps, n, lanes).transpose(1, 0, 2).reshape(n, -1)]
        return np.concatenate([row[: int(b["tokens"])] for row, b in zip(tokens, checks)])

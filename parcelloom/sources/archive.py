"""One file of vector tiles: the public PMTiles layout, version 3.

A header of 127 bytes, a directory of tiles in the order of a Hilbert curve through all zooms (in leaves where one
directory is too long), metadata and the tiles' bytes in the same order.
"""

from __future__ import annotations

import gzip
import itertools
import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.sources.tables import _fs

_HEAD = struct.Struct("<7sB11Q6B4iB2i")
#: Bytes that header and root directory may have together, and entries of a leaf.
ROOT_MOST, LEAF = 16384, 4096
_GZIP, _MVT = 2, 1


def tile_id(zoom: int, x: int, y: int) -> int:
    """The tile's number along the curve, after all tiles of smaller zooms."""
    out, side = (4**zoom - 1) // 3, 1 << zoom >> 1
    while side:
        rx, ry = int(x & side > 0), int(y & side > 0)
        out += side * side * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x & side - 1, side - 1 - y & side - 1
            x, y = y, x
        side >>= 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _varints(raw: bytes):
    value = shift = 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield value
            value = shift = 0


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries ``(id, offset, length, run)``, gzipped; a run of 0 is a leaf."""
    ids = [e[0] for e in entries]
    follows = [i > 0 and entries[i][1] == entries[i - 1][1] + entries[i - 1][2] for i in range(len(entries))]
    columns = [b - a for a, b in zip([0, *ids], ids)], [e[3] for e in entries], [e[2] for e in entries], [0 if f else e[1] + 1 for e, f in zip(entries, follows)]
    return gzip.compress(b"".join(map(_varint, [len(entries), *itertools.chain(*columns)])), mtime=0)


def entries_of(raw: bytes) -> list[tuple[int, int, int, int]]:
    numbers = list(_varints(gzip.decompress(raw)))
    n = numbers[0]
    ids, runs, lengths, offsets = itertools.accumulate(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 : 3 * n + 1], numbers[3 * n + 1 :]
    out: list = []
    for i, run, length, at in zip(ids, runs, lengths, offsets):
        out.append((i, at - 1 if at else out[-1][1] + out[-1][2], length, run))
    return out


def write_archive(tiles: DataFrame, path: str, bounds: tuple[float, float, float, float]) -> int:
    """``tiles(zoom, x, y, tile)``, a table that reads the same twice, as one file; returns how many there are.

    Numbers and sizes come to the driver for the directory; the bytes are streamed through it in order, as they go
    to one file.  No tiles give an archive without any.
    """
    spark = tiles.sparkSession

    @F.udf("long", useArrow=True)
    def number(zoom, x, y):
        return tile_id(zoom, x, y)

    rows = tiles.select(number("zoom", "x", "y").alias("id"), "zoom", "tile")
    sizes = [(r["id"], r["n"], r["zoom"]) for r in rows.select("id", F.octet_length("tile").alias("n"), "zoom").orderBy("id").toLocalIterator()]
    entries, at = [], 0
    for i, n, _ in sizes:
        entries.append((i, at, n, 1))
        at += n
    root, leaves = directory(entries), b""
    if _HEAD.size + len(root) > ROOT_MOST:
        tops = []
        for lo in range(0, len(entries), LEAF):
            leaf = directory(entries[lo : lo + LEAF])
            tops.append((entries[lo][0], len(leaves), len(leaf), 0))
            leaves += leaf
        root = directory(tops)
    about = gzip.compress(json.dumps({"name": path.rstrip("/").split("/")[-1]}).encode(), mtime=0)
    e7 = [round(v * 1e7) for v in bounds]
    zooms = [z for _, _, z in sizes] or [0]
    start = _HEAD.size
    head = _HEAD.pack(
        b"PMTiles", 3, start, len(root), start + len(root), len(about), start + len(root) + len(about), len(leaves), start + len(root) + len(about) + len(leaves), at,
        len(entries), len(entries), len(entries), 1, _GZIP, _GZIP, _MVT, min(zooms), max(zooms), *e7, min(zooms), (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2,
    )
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(head + root + about + leaves))
    for r in rows.select("id", "tile").orderBy("id").toLocalIterator():
        out.write(bytearray(r["tile"]))
    out.close()
    return len(entries)


def read_archive(raw: bytes) -> dict[int, bytes]:
    """The tiles of an archive by their number."""
    if raw[:8] != b"PMTiles\x03":
        raise ValueError("not an archive of version 3")
    root, root_n, _, _, leaf, _, data = _HEAD.unpack_from(raw)[2:9]
    out: dict[int, bytes] = {}
    pending = entries_of(raw[root : root + root_n])
    while pending:
        i, at, n, run = pending.pop()
        if run == 0:
            pending += entries_of(raw[leaf + at : leaf + at + n])
        for k in range(run):
            out[i + k] = raw[data + at : data + at + n]
    return out

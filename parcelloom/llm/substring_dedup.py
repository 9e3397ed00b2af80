"""Substring dedup with fixed-block anchors.

A repeat of 13 words holds a whole block of 7 words of the earlier document's division into blocks.  So the
blocks are the index, every rolling run of 7 words is a probe, and hits are extended to whole windows.

1.  Scan.  Each batch of texts is kept as a compressed chunk file in the shared folder.  Its runs and blocks are
    sorted; what the chunk itself decides (a run whose block an earlier document of the chunk has) stays there, and
    of the rest each run goes once for each document, packed, to the part of the hash range it belongs to.  A
    run that many documents have leaves a chunk a few times, not once for each document.
2.  Each part finds, for each run, the least document with it as a block and the greatest with it at all, and
    answers with bits: which probes are hit by an earlier block, which blocks hit a later probe.
3.  Extension.  The windows around hits go, with fingerprints of 126 bits, the same way as the runs: those of the
    earlier document around its block, those of the later one around its probe.  The answer is which windows start in
    an earlier document.  Overlapping windows make up the maximal repeats.
4.  Each chunk is read again and the words that repeats cover are removed.

Texts are not shuffled, and an entry of the shuffles has a size that depends on nothing but the spread of its chunk's
doc_ids.  Chunks have names that a rerun of a task gives again, so a lost executor costs its tasks.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.llm import textkernel as tk
from parcelloom.llm.shared import filesystem, parts_for, release, shared_dir, small_batches, written

CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 16000
#: Bits of a run's fingerprint within its part; windows have 62 and 64 more.
RUN_BITS = 28
_NONE = np.iinfo(np.int64).max
_ROWS = "chunk string, part int, base long, keys binary, docs binary, flags binary"
_MASKS = "chunk string, kind int, part int, a binary, b binary"


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit differences; 65535 adds up without being a number."""
    gap = np.diff(keys, prepend=np.zeros(1, keys.dtype)).astype(np.int64)
    wide = gap // 65535
    out = np.full(len(gap) + int(wide.sum()), 65535, dtype="<u2")
    out[np.cumsum(wide + 1) - 1] = gap % 65535
    return out.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    gap = np.frombuffer(raw, "<u2")
    return np.cumsum(gap, dtype=np.int64)[gap != 65535]


def _width(ids: np.ndarray) -> str:
    """The least type that holds the distances of sorted ids from the first."""
    far = int(ids[-1]) - int(ids[0]) if len(ids) else 0
    return "<u2" if far < 1 << 16 else "<u4" if far < 1 << 32 else "<u8"


def _least(value: np.ndarray, use: np.ndarray, begins: np.ndarray, none: int) -> np.ndarray:
    """For each row the least value in use in its run."""
    low = np.minimum.reduceat(np.where(use, value, none), begins)
    return np.repeat(low, np.diff(np.append(begins, len(value))))


@dataclass
class Chunk:
    """The runs of a chunk's texts: a row for each different run and document, in order."""

    ids: np.ndarray  # the chunk's doc_ids, sorted, each once
    rank: np.ndarray  # each text's place in ids
    hash: np.ndarray  # words
    again: np.ndarray  # words, by another seed; of none where positions are not asked for
    doc: np.ndarray
    first: np.ndarray
    at: np.ndarray  # where runs begin (words)
    row: np.ndarray | None  # each run's row
    key: np.ndarray  # rows: part and fingerprint
    owner: np.ndarray  # rows: rank
    block: np.ndarray  # rows: whether it is a block of its document
    probe_hit: np.ndarray  # rows: what the chunk decides by itself
    block_hit: np.ndarray
    sent: np.ndarray  # rows that are sent


class Method:
    def __init__(self, window: int, parts: int) -> None:
        self.window, self.run, self.parts = window, (window + 1) // 2, parts

    def chunk(self, ids: np.ndarray, texts: pa.Array, positions: bool) -> Chunk:
        sorted_ids, rank = np.unique(ids, return_inverse=True)
        h, doc, first = tk.all_words(texts)
        again = tk.all_words(texts, seed=1)[0] if positions else np.zeros(0, np.uint64)
        n = self.run
        if len(h) >= n:
            long = np.diff(first) >= self.window
            at = np.flatnonzero((doc[: len(doc) - n + 1] == doc[n - 1 :]) & long[doc[: len(doc) - n + 1]])
        else:
            at = np.zeros(0, np.int64)
        g = tk.shingles(h, n)[at] if len(at) else np.zeros(0, np.uint64)
        key = (g % np.uint64(self.parts)) << np.uint64(RUN_BITS) | g // np.uint64(self.parts) & np.uint64((1 << RUN_BITS) - 1)
        block = (at - first[doc[at]]) % n == 0
        packed = key << np.uint64(16) | rank[doc[at]].astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)
        row = None
        if positions:
            order = np.argsort(packed, kind="stable")
            packed = packed[order]
        else:
            packed = np.sort(packed)
        last = np.append((packed[1:] ^ packed[:-1]) > 1, True) if len(packed) else np.zeros(0, bool)
        # neighbours that differ in the lowest bit only may still be of two rows
        if len(packed):
            last[:-1] = (packed[1:] >> np.uint64(1)) != (packed[:-1] >> np.uint64(1))
        if positions:
            row = np.empty(len(packed), dtype=np.int64)
            row[order] = np.cumsum(np.concatenate([[0], last[:-1]])) if len(packed) else 0
        packed = packed[last]
        key, owner, block = packed >> np.uint64(16), (packed >> np.uint64(1) & np.uint64(0x7FFF)).astype(np.int64), (packed & np.uint64(1)).astype(bool)
        if not len(key):
            none = np.zeros(0, bool)
            return Chunk(sorted_ids, rank, h, again, doc, first, at, row, key, owner, none, none, none, none)
        new = tk.first_of_runs(key)
        begins = np.flatnonzero(new)
        least = _least(owner, block, begins, 1 << 20)
        most = np.repeat(owner[np.append(begins[1:], len(key)) - 1], np.diff(np.append(begins, len(key))))
        return Chunk(sorted_ids, rank, h, again, doc, first, at, row, key, owner, block, owner > least, block & (owner < most), (owner <= least) | (owner == most))

    def windows(self, c: Chunk, masks: dict) -> tuple[np.ndarray, ...]:
        """Where candidate windows begin, each one's row, and the rows: keys, rank, probe, ref, hit within the chunk, sent."""
        probe, block = c.probe_hit.copy(), c.block_hit.copy()
        sent = np.flatnonzero(c.sent)
        bounds = np.searchsorted((c.key[sent] >> np.uint64(RUN_BITS)).astype(np.int64), np.arange(self.parts + 1))
        for part, (a, b) in masks.items():
            rows = sent[bounds[part] : bounds[part + 1]]
            probe[rows] |= np.unpackbits(np.frombuffer(a, np.uint8), count=len(rows)).astype(bool)
            block[rows] |= np.unpackbits(np.frombuffer(b, np.uint8), count=len(rows)).astype(bool)
        n, k = len(c.hash), self.window
        hit = np.zeros(n + 1, dtype=np.int32)
        anchor = np.zeros(n + self.run, dtype=bool)
        if len(c.at):
            hit[1:][c.at] = probe[c.row]
            anchor[c.at] = block[c.row] & ((c.at - c.first[c.doc[c.at]]) % self.run == 0)
        seen = np.cumsum(hit)
        start = np.flatnonzero(c.doc[: n - k + 1] == c.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        is_probe = seen[start + self.run] > seen[start]  # a hit run lies in the window
        is_ref = anchor[start + (-(start - c.first[c.doc[start]])) % self.run]
        use = is_probe | is_ref
        start, is_probe, is_ref = start[use], is_probe[use], is_ref[use]
        key = (tk.shingles(c.hash, k)[start] if len(start) else np.zeros(0, np.uint64)) >> np.uint64(2)
        key = np.stack([key, tk.shingles(c.again, k)[start] if len(start) else key], axis=1)
        owner = c.rank[c.doc[start]]
        order = np.lexsort((owner, key[:, 1], key[:, 0], key[:, 0] % np.uint64(self.parts)))
        new = tk.first_of_runs(key[order, 0], key[order, 1], owner[order]) if len(order) else np.zeros(0, bool)
        row = np.empty(len(order), dtype=np.int64)
        row[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        if not len(begins):
            none = np.zeros(0, bool)
            return start, row, key, owner, none, none, none, none
        p = np.logical_or.reduceat(is_probe[order], begins)
        r = np.logical_or.reduceat(is_ref[order], begins)
        key, owner = key[order][begins], owner[order][begins]
        least = _least(owner, r, np.flatnonzero(tk.first_of_runs(key[:, 0], key[:, 1])), 1 << 20)
        return start, row, key, owner, p, r, p & (owner > least), (p & (owner <= least)) | (r & (owner == least))


def _open(fs, path: str, name: str) -> tuple[np.ndarray, pa.Array]:
    with fs.open_input_file(f"{path}/{name}.arrow") as f:
        table = pa.ipc.open_file(f).read_all().combine_chunks()
    return table.column(0).combine_chunks().to_numpy(zero_copy_only=False), table.column(1).combine_chunks()


def _save(fs, path: str, name: str, ids: np.ndarray, texts: pa.Array) -> None:
    """Under a name of its own first, so that no reader ever sees half a file."""
    table = pa.table({"doc_id": pa.array(ids), "text": texts})
    task = TaskContext.get()
    draft = f"{path}/{name}.{task.taskAttemptId()}.draft"
    with fs.open_output_stream(draft) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    fs.move(draft, f"{path}/{name}.arrow")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _scan(method: Method, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        number = itertools.count()
        part_id = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
            at, lo = tk.string_buffers(batch.column(1))[1], 0
            while lo < len(ids):
                hi = min(len(ids), lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1))
                name, texts = f"{part_id:06d}-{next(number):05d}", batch.column(1).slice(lo, hi - lo)
                _save(fs, path, name, ids[lo:hi], texts)
                c = method.chunk(ids[lo:hi], texts, False)
                rows = [(name, -1 - zlib.crc32(name.encode()) % method.parts, None, None, None, None)]
                key, block = c.key[c.sent], c.block[c.sent]
                docs = (c.ids - c.ids[0]).view(np.uint64).astype(_width(c.ids))[c.owner[c.sent]]
                bounds = np.searchsorted((key >> np.uint64(RUN_BITS)).astype(np.int64), np.arange(method.parts + 1))
                low = (key & np.uint64((1 << RUN_BITS) - 1)).astype(np.int64)
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[p], bounds[p + 1])
                    rows.append((name, p, int(c.ids[0]), _pack(low[own]), docs[own].tobytes(), _bits(block[own])))
                yield _batch(_ROWS, rows)
                lo = hi
        release()

    return run


def _by_part(solve):
    """Apply ``solve`` to all rows of a part at a time; rows that only name a chunk go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != now and rows:
                    yield _batch(_MASKS, solve(rows))
                    rows = []
                now = row[1]
                rows.append(row)
        if rows:
            yield _batch(_MASKS, solve(rows))

    return run


def _entries(rows: list[tuple], unpack, flags: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """The entries of a part's rows one after another: keys, ids and so many flags; and where each row's begin."""
    keys = [unpack(r[3]) for r in rows]
    ids = [(np.frombuffer(r[4], f"<u{len(r[4]) // len(k)}").astype(np.uint64) + np.int64(r[2]).view(np.uint64)).view(np.int64) for r, k in zip(rows, keys)]
    size = [-(-len(k) // 8) for k in keys]
    bits = [np.concatenate([np.unpackbits(np.frombuffer(r[5][f * n : (f + 1) * n], np.uint8), count=len(k)) for r, k, n in zip(rows, keys, size)]).astype(bool) for f in range(flags)]
    return np.concatenate(keys), np.concatenate(ids), bits, np.cumsum([0, *map(len, keys)]).tolist()


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _probe_part(rows: list[tuple]) -> list[tuple]:
    if rows[0][1] < 0:
        return [(r[0], 0, r[1], None, None) for r in rows]
    key, doc, (flag,), ends = _entries(rows, _unpack, 1)
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(tk.first_of_runs(key[order]))
    d, block = doc[order], flag[order]
    most = np.repeat(np.maximum.reduceat(d, begins), np.diff(np.append(begins, len(d))))
    probe_hit, block_hit = np.empty(len(d), bool), np.empty(len(d), bool)
    probe_hit[order] = d > _least(d, block, begins, _NONE)
    block_hit[order] = block & (d < most)
    return [(r[0], 1, r[1], _bits(probe_hit[a:b]), _bits(block_hit[a:b])) for r, a, b in zip(rows, ends, ends[1:]) if probe_hit[a:b].any() or block_hit[a:b].any()]


def _window_part(rows: list[tuple]) -> list[tuple]:
    key, doc, (probe, ref), ends = _entries(rows, lambda raw: np.frombuffer(raw, "<u8").reshape(-1, 2), 2)
    order = np.lexsort((key[:, 1], key[:, 0]))
    begins = np.flatnonzero(tk.first_of_runs(key[order, 0], key[order, 1]))
    d = doc[order]
    hit = np.empty(len(d), bool)
    hit[order] = probe[order] & (d > _least(d, ref[order], begins, _NONE))
    return [(r[0], 2, r[1], _bits(hit[a:b]), None) for r, a, b in zip(rows, ends, ends[1:]) if hit[a:b].any()]


def _masks(found: list[dict], kind: int) -> dict:
    return {x["part"]: (x["a"], x["b"]) for x in found if x["kind"] == kind}


def _extend(method: Method, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = method.chunk(*_open(fs, path, name), True)
                _, _, key, owner, probe, ref, _, sent = method.windows(c, _masks(found, 1))
                key, probe, ref = key[sent], probe[sent], ref[sent]
                if not len(key):
                    continue
                docs = (c.ids - c.ids[0]).view(np.uint64).astype(_width(c.ids))[owner[sent]]
                bounds = np.searchsorted((key[:, 0] % np.uint64(method.parts)).astype(np.int64), np.arange(method.parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[p], bounds[p + 1])
                    rows.append((name, p, int(c.ids[0]), key[own].astype("<u8").tobytes(), docs[own].tobytes(), _bits(probe[own]) + _bits(ref[own])))
                yield _batch(_ROWS, rows)
        release()

    return run


def _remove(method: Method, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, texts = _open(fs, path, name)
                c = method.chunk(ids, texts, True)
                start, row, key, _, _, _, hit, sent = method.windows(c, _masks(found, 1))
                sent = np.flatnonzero(sent)
                bounds = np.searchsorted((key[sent, 0] % np.uint64(method.parts)).astype(np.int64), np.arange(method.parts + 1))
                for part, (a, _) in _masks(found, 2).items():
                    rows = sent[bounds[part] : bounds[part + 1]]
                    hit[rows] |= np.unpackbits(np.frombuffer(a, np.uint8), count=len(rows)).astype(bool)
                gone = tk.covered(len(c.hash), start[hit[row]], method.window) if len(start) else np.zeros(len(c.hash), bool)
                removed = np.bincount(c.doc[gone], minlength=len(ids))
                data, at = tk.string_buffers(texts)
                kept, raw = [], data.tobytes()
                for d in range(len(ids)):
                    words = raw[at[d] : at[d + 1]].split()
                    if removed[d]:
                        words = itertools.compress(words, (~gone[c.first[d] : c.first[d + 1]]).tolist())
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=ids == _NONE), pa.array(np.diff(c.first)), pa.array(removed.astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        release()

    return run


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the words of windows that start in a document with a smaller doc_id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and ``kept_text`` (the kept words joined by single spaces) for
    every row.  Windows are judged on the input.  A null, empty or blank text has no words.  Rows with one doc_id
    don't remove from each other, whatever their texts; a null doc_id counts as the greatest.  Other columns are ignored; an
    empty table gives an empty result.  Windows are the same if two independent fingerprints of their words are, which
    have 126 bits together.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folder = f"{shared_dir(docs.sparkSession)}/chunks"
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    parts = parts_for(docs.count(), 4096)
    method = Method(window, parts)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "part").sortWithinPartitions("part")

    probes = written(dealt(docs.mapInArrow(_scan(method, folder), _ROWS)).mapInArrow(_by_part(_probe_part), _MASKS), "probes")
    chunks = probes.where("kind = 0").count()

    def by_chunk(masks: DataFrame) -> DataFrame:
        return masks.repartition(max(1, min(2 * chunks, 65536)), "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "a", "b")).alias("found"))

    windows = by_chunk(probes).mapInArrow(_extend(method, folder), _ROWS)
    answers = written(dealt(windows).mapInArrow(_by_part(_window_part), _MASKS), "windows")
    out = by_chunk(probes.unionByName(answers))
    return out.mapInArrow(_remove(method, folder), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_fixed_block_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (g) WHERE m < doc_id),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

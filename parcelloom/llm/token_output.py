"""Token ids of documents in files coded by a range asymmetric numeral system (see ``rans``).

Documents are dealt out by ranges of their ids and sorted, so that files in order hold documents in order.
A task encodes its documents with the tokenizer and writes a segment file whenever it has
``SEGMENT_TOKENS`` ids, and at its end.  Files have names of their own for each attempt; those that the
manifest names are the valid ones.  Reading takes the manifest, in which each file has its place.

A tokenizer that drops white space encodes each distinct word once, not once for each time it stands in a text;
wherever such a word stands its bytes are compared with those that were encoded.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelloom.llm import rans
from parcelloom.llm import textkernel as tk
from parcelloom.llm.shared import filesystem, parts_for, release, shared_dir, small_batches, written

SEGMENT_TOKENS = 4 << 20
#: Words whose ids a Python worker remembers from task to task, and bytes of text that are encoded at a time.
REMEMBERED, AT_ONCE = 2 << 20, 4 << 20
#: A word that no other text shares a token with; words that hold it are encoded one by one.
_MARK = "\x01"
_ENCODERS: dict = {}


class TextEncoder:
    """Ids of whole texts.

    If the tokenizer drops white space, texts are put together from the ids of their words, which are kept by
    the words' fingerprints and spelled out beside them; new words are encoded many to a line, with marks between
    them.  Should a word have the fingerprint of another one, its whole batch is encoded text by text.
    """

    def __init__(self, path: str) -> None:
        # tasks are what runs side by side
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        a, b, both, mark = (self._ids([x])[0] for x in ("a", "b", f" a\t{_MARK} \nb ", _MARK))
        self.by_word = len(mark) == 1 and both == [*a, *mark, *b]
        self.mark = mark[0] if mark else -1
        self._forget()

    @classmethod
    def of(cls, path: str) -> "TextEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.number, self.at, self.size = (np.zeros(0, np.int32) for _ in range(4))
        self.ids, self.spelled = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for lo in range(0, len(texts), 64 * 256):
            here = texts[lo : lo + 64 * 256]
            lines = self._ids([f" {_MARK} ".join([*here[i : i + 64], ""]) for i in range(0, len(here), 64)])
            parts += [np.array(x, dtype=np.uint32) for x in lines]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self._ids([t])[0], dtype=np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        odd = np.array([_MARK.encode() in t for t in words])
        for use, encode in ((~odd, self._encode_words), (odd, self._one_by_one)):
            if use.any():
                mine = [t for t, u in zip(words, use.tolist()) if u]
                ids, number = encode([t.decode("utf-8") for t in mine])
                size = np.array([len(t) for t in mine], dtype=np.int64)
                begin = len(self.ids) + np.cumsum(number) - number
                spelled = len(self.spelled) + np.cumsum(size) - size
                at = np.searchsorted(self.known, h[use])
                self.known = np.insert(self.known, at, h[use])
                self.begin, self.number = np.insert(self.begin, at, begin), np.insert(self.number, at, number)
                self.at, self.size = np.insert(self.at, at, spelled), np.insert(self.size, at, size)
                self.ids = np.concatenate([self.ids, ids])
                self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(mine), np.uint8)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and how many each has."""
        if not self.by_word:
            return self._one_by_one(column.fill_null("").to_pylist())
        found = list(tk.words(column))
        new: dict[int, bytes] = {}
        # words are looked up once for each group of texts, in the order of what is known
        places = []
        for w in found:
            h, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
            places.append((h, place))
            fresh = ~self._knows(h)
            for x, i in zip(h[fresh].tolist(), first[fresh].tolist()):
                if x not in new:
                    new[x] = w.data[w.start[i] : w.end[i]].tobytes()
        if new:
            if len(self.known) and (len(self.known) + len(new) > REMEMBERED or len(self.spelled) > 16 * REMEMBERED):
                self._forget()
                return self.encode(column)
            h = np.sort(np.array(list(new), dtype=np.uint64))
            self._learn(h, [new[x] for x in h.tolist()])
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for w, (h, place) in zip(found, places):
            at = np.searchsorted(self.known, h)[place]
            if len(at) and not tk.same_bytes(w.data, w.start, w.end, self.spelled, self.at[at], self.size[at]).all():
                return self._one_by_one(column.fill_null("").to_pylist())
            begin, number = self.begin[at].astype(np.int64), self.number[at].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(number)])
            ids.append(self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], number)])
            counts.append(np.diff(total[w.first()]))
        return np.concatenate(ids), np.concatenate(counts)

    def _knows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h), dtype=bool)
        return self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(tokenizer)
        fs, path = filesystem(folder)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        docs: list = []
        counts: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            n, doc = np.concatenate(counts), np.concatenate(docs)
            tokens = np.concatenate(ids)
            name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.rans"
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(rans.encode(tokens, doc, n))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "docs": [len(n)], "tokens": [len(tokens)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            ids.clear(), docs.clear(), counts.clear()
            seq, held = seq + 1, 0
            return row

        for batch in batches:
            # a null id is written as the least number, which comes first as nulls do
            doc = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at, lo = tk.string_buffers(batch.column(1))[1], 0
            while lo < len(doc):
                hi = min(len(doc), max(lo + 1, int(np.searchsorted(at, at[lo] + AT_ONCE, "right")) - 1))
                got, n = encoder.encode(batch.column(1).slice(lo, hi - lo))
                ids.append(np.insert(got, np.cumsum(n), end_id).astype(np.uint32))
                docs.append(doc[lo:hi])
                counts.append(n + 1)
                held += len(ids[-1])
                if held >= SEGMENT_TOKENS:
                    yield flush()
                lo = hi
        if held:
            yield flush()
        release()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents to files in ``folder``, in the order of doc_id; the manifest.

    The manifest has a row for each file: ``file, docs, tokens, start``, the last being the number of ids in
    the files before.  A null or empty text is the end id alone.  A null doc_id comes first; rows that repeat
    a doc_id are in the order of their texts.  Other columns are ignored; an empty table gives no file.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = parts_for(docs.count(), 4096, 8)
    files = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id), "part int, seq int, file string, docs long, tokens long")
    files = written(files, "manifest")
    # a row for each partition (65536 at most), then within partitions
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before.alias("_before"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("_in", within).join(of_part, "part").select("file", "docs", "tokens", (F.col("_before") + F.col("_in")).alias("start"))


def _read(folder: str, fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as f:
                    segment = rans.Segment(f.read())
                yield fn(segment, segment.decode(), start)
        release()

    return run


def _ids(segment: rans.Segment) -> pa.Array:
    return pa.array(segment.doc_ids.astype(np.int64), mask=segment.doc_ids == np.iinfo(np.int64).min)


def _digest(segment: rans.Segment, tokens: np.ndarray, start: int) -> pa.RecordBatch:
    n = segment.doc_tokens.astype(np.int64)
    ends = np.cumsum(n)
    raw = tokens.astype("<u4")
    crc = [zlib.crc32(raw[b - k : b]) for b, k in zip(ends.tolist(), n.tolist())]
    return pa.RecordBatch.from_arrays([_ids(segment), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _documents(segment: rans.Segment, tokens: np.ndarray, start: int) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(segment.doc_tokens.astype(np.int64))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([_ids(segment), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int64)))], names=["doc_id", "ids"])


def _files(manifest: DataFrame) -> DataFrame:
    n = manifest.count()
    return manifest.select("file", "start").repartition(max(1, min(n, 65536)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, ids`` of every document in the files."""
    return _files(manifest).mapInArrow(_read(folder, _documents), "doc_id long, ids array<long>")


def token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    return _files(manifest).mapInArrow(_read(folder, _digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, and what is read back from them."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    return token_digests(write_tokens(docs, folder, tokenizer, end_id), folder)


def op5_rans_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents with the public word tokenizer."""
    import public_tokenizers

    return written_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

"""N-gram Jaccard join: a blocked product of the document by n-gram incidence matrix with its transpose.

1.  One scan makes each text's set of word shingles, its size and a fingerprint of the whole set.  Texts
    with equal sets are one class from there on, however many copies there are.
2.  Blocking, without loss: a set of n shingles differs from a larger one of similarity t in at most n(1-t)/t
    shingles, and from a smaller one in at most 2n(1-t)/(1+t).  The shingles' hash range is cut, by size class,
    into so many ranges that more of them hold several of a set's shingles than that; so two similar sets agree
    on all shingles of such a range.  Few sets have too few such ranges; those also give single shingles, a
    prefix in hash order.  Equal ranges meet in a shuffle of packed keys; each task reduces what met to a
    spanning forest.  The components of all forests are the row blocks.  Ranges of one shingle make no
    keys, as texts with a passage in common would all hang together by them.
    A block of more rows than one part may hold may hang together by passages that many texts have.  Its rows are
    blocked anew, without loss: with shingles in the order of their numbers of texts, two similar sets of n and
    m shingles share one of the n - ceil(tn) + 1 and m - ceil(tm) + 1 rarest ones.
3.  Within a row block the product of the incidence matrix with its transpose is summed over blocks of
    columns; entries below the bound that the two sizes give are discarded, the others are links.  A block
    of many or large rows is cut, and each pair of its parts is a task of its own.  Tasks give each row's
    number of links and a spanning forest of them, never the pairs.
4.  The components of these forests are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelloom.llm import textkernel as tk
from parcelloom.llm.components import connected, local_components
from parcelloom.llm.shared import numbered, parts_for, restored, written

#: Rows, and shingles in all, of a part of a row block.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2 << 20
#: Rows of a tile of the product, and columns that are multiplied at a time.
TILE, COLUMNS = 1024, 2048


class SizeClasses:
    """Classes of set sizes such that similar sets lie in the same or in neighbouring classes."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = np.array([1], dtype=np.int64)
        # mean shingles of a range in the largest sets of a class: as many as leave a fifth more ranges with
        # two or more, by Poisson's law, than similar sets can differ in
        self.load, x = 1.8, 1.8
        while x < 12:
            if (1 - (1 + x) * math.exp(-x)) / x >= 1.22 * 2 * (den - num) / (den + num):
                self.load = x
            x += 0.05

    def upto(self, n: int) -> None:
        low = list(self.low)
        while low[-1] <= n:
            low.append(low[-1] * self.den // self.num + 1)
        self.low = np.array(low, dtype=np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        self.upto(int(n.max(initial=1)))
        return np.searchsorted(self.low, n, "right") - 1

    def ranges(self, c: np.ndarray) -> np.ndarray:
        """Into how many ranges sets are cut where the larger one of a pair is of class ``c``."""
        return np.maximum(1, np.ceil(self.low[c] * self.den // self.num / self.load)).astype(np.int64)


def range_keys(h: np.ndarray, at: np.ndarray, sizes: SizeClasses) -> tuple[np.ndarray, np.ndarray]:
    """``(text, key)`` such that two texts with similar sets have a key in common.

    ``h`` holds the sorted 52-bit shingles of each text, ``at`` where each text's begin.  Each set is cut
    for its own class and for the next one, as the larger set of a pair decides.  A pair has a range of two
    or more shingles in common if the larger set has more of them than it can differ in from a smaller one, or
    the smaller more than it can differ in from a larger one; sets that fail as either give their smallest
    shingles too, as many as a similar set cannot all lack.
    """
    n = np.diff(at)
    some = np.flatnonzero(n)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    num, den = sizes.num, sizes.den
    text = np.repeat(np.arange(len(n)), n)
    scrambled = tk.mix64(h)
    out_text, out_key = [], []
    sparse = np.zeros(len(n), dtype=bool)
    own = sizes.of(n[some])
    sizes.upto(int(sizes.low[own.max() + 1]) + 1)
    for step in (0, 1):
        c = np.zeros(len(n), dtype=np.int64)
        c[some] = own + step
        at_range = (h >> np.uint64(20)) * sizes.ranges(c)[text].astype(np.uint64) >> np.uint64(32)
        begins = np.flatnonzero(tk.first_of_runs(text, at_range))
        total = np.add.reduceat(scrambled, begins)
        t = text[begins]
        # a set of one shingle is a key as a whole where it has no larger set to be similar to
        use = (np.diff(np.append(begins, len(text))) > 1) | ((n[t] == 1) & (den < 2 * num))
        seed = tk.mix64(c[t].astype(np.uint64) << np.uint64(32) | at_range[begins])
        out_text.append(t[use])
        out_key.append(tk.mix64(total ^ seed)[use])
        full = np.bincount(t[use], minlength=len(n))
        sparse |= full <= n * (den - num) // num
        if step == 0:
            sparse |= full <= 2 * n * (den - num) // (den + num)
    sparse &= n > 0
    if sparse.any():
        rank = np.arange(len(h)) - np.repeat(at[:-1], n)
        prefix = n - -(-n * num // den) + 1
        pick = sparse[text] & (rank < prefix[text])
        out_text.append(text[pick])
        out_key.append(tk.mix64(scrambled[pick] + np.uint64(0x1B873593)))
    return np.concatenate(out_text), np.concatenate(out_key)


def _pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _speakers(ids: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which rows have the smallest id of those with their fingerprints.  The smallest id of all is one of its batch's."""
    order = np.lexsort((ids, prints[:, 1], prints[:, 0]))
    out = np.zeros(len(ids), dtype=bool)
    out[order[tk.first_of_runs(prints[order, 0], prints[order, 1])]] = True
    return out


_SCAN = "part int, ids binary, counts binary, body binary"


def _scan(k: int, num: int, den: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = SizeClasses(num, den)
        schema = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ns, prints, texts, keys = [], [], [], []
            for w in tk.words(batch.column(1), lower=True):
                h, at = tk.shingle_sets(w, k)
                n = np.diff(at)
                ns.append(n)
                sums = np.zeros((len(n), 2), dtype=np.uint64)
                if len(h):
                    full = n > 0
                    sums[full, 0] = np.add.reduceat(tk.mix64(h), at[:-1][full])
                    sums[full, 1] = np.add.reduceat(tk.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
                prints.append(sums)
                text, key = range_keys(h, at, sizes)
                texts.append(text + w.lo)
                keys.append(key)
            if not ns:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.concatenate(ns).astype(np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(prints).tobytes()], pa.binary())], schema=schema)
            text, key = np.concatenate(texts), np.concatenate(keys)
            # of equal sets the smallest id speaks for the batch, so that copies of a page don't meet in a shuffle
            use = _speakers(ids, np.concatenate(prints))[text]
            text, key = text[use], key[use]
            part = (key % np.uint64(parts)).astype(np.int64)
            key = key // np.uint64(parts) & np.uint64((1 << 40) - 1)
            order = np.argsort(part * len(ids) + text, kind="stable")
            text, key, part = text[order], key[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(bounds)):
                t = text[bounds[p] : bounds[p + 1]]
                begin = np.flatnonzero(tk.first_of_runs(t))
                count = np.diff(np.append(begin, len(t)))
                rows.append((int(p), ids[t[begin]].tobytes(), count.astype(np.uint32).tobytes(), _pack40(key[bounds[p] : bounds[p + 1]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, ids, counts, body in zip(*(c.to_pylist() for c in batch.columns)):
            prints = np.frombuffer(body, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1]))], names=["doc_id", "n_shingles", "f0", "f1"])


def _forest(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest id that ``u``-``v`` (positions in sorted ``ids``) reach."""
    root = local_components(len(ids), u, v)
    off = np.flatnonzero(root != np.arange(len(ids)))
    return ids[off], ids[root[off]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the texts that have a key in common, a part of the key space at a time."""

    def solve(docs: list, keys: list) -> pa.RecordBatch:
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        new = tk.first_of_runs(key)
        shared = ~new | np.append(~new[1:], False)
        key, doc = key[shared], doc[shared]
        ids, place = np.unique(doc, return_inverse=True)
        if not len(ids):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["u", "v"])
        begins = np.flatnonzero(tk.first_of_runs(key))
        hub = np.repeat(np.minimum.reduceat(place, begins), np.diff(np.append(begins, len(key))))
        u, v = _forest(ids, place, hub)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    now, docs, keys = None, [], []
    for batch in batches:
        for part, ids, counts, body in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and docs:
                yield solve(docs, keys)
                docs, keys = [], []
            now = part
            docs.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)))
            keys.append(_unpack40(body))
    if docs:
        yield solve(docs, keys)


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tk.words(batch.column(batch.schema.get_field_index("text")), lower=True):
                h, at = tk.shingle_sets(w, k)
                rest = [batch.column(i).slice(w.lo, w.texts) for i, f in enumerate(batch.schema) if f.name != "text"]
                body = pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(w.texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, body], names=[*(f.name for f in batch.schema if f.name != "text"), "body"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the incidence matrix: document, size and 32 bits of the set's fingerprint (documents may share an id), shingle."""
    for batch in batches:
        sets = batch.column(1).to_pylist()
        h = np.frombuffer(b"".join(sets), np.uint64)
        n = np.array([len(x) // 8 for x in sets], dtype=np.int64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix64(h))])
        own = n << 32 | (np.diff(total[np.concatenate([[0], np.cumsum(n)])]) >> np.uint64(32)).astype(np.int64)
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, n)), pa.array(np.repeat(own, n)), pa.array(h.astype(np.int64))], names=["doc_id", "own", "shingle"])


def rare_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, root)`` of the documents that hang together by shingles that are rare among ``rows(doc_id, body)``.

    A document that has none of its rarest shingles in common is in no block.
    """
    entries = written(rows.select("doc_id", "body").mapInArrow(_entries, "doc_id long, own long, shingle long"), "entries")
    # written before it is joined back, so that a frequent shingle's entries can be split over tasks
    often = written(entries.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # shingles of one text come last here and are needed for nothing; repeated rows have the same ranks
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "own").orderBy(F.desc("n"), F.desc("shingle")))
    least = F.ceil(F.shiftright("own", 32) * num / den)
    keys = written(entries.join(often, "shingle").withColumn("rank", rank).where(F.col("rank") >= least).select("shingle", "doc_id"), "keys")
    hubs = written(keys.groupBy("shingle").agg(F.min("doc_id").alias("v")), "hubs")
    return connected(keys.join(hubs, "shingle").select(F.col("doc_id").alias("u"), "v"))


def _cut(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the matrix: ``doc_id, root, copies``, into how many parts their block is cut and the part they are of."""
    # only classes' smallest documents are rows of the matrix
    members = blocks.join(classes.select(F.col("rep").alias("node"), "copies", "n"), "node")
    of_block = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).where("rows > 1")
    cut = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = members.join(of_block.select("root", cut.alias("cut")), "root")
    members = members.select(F.col("node").alias("doc_id"), "root", "copies", "cut", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int").alias("own"))
    return members.dropDuplicates(["doc_id"])


def links(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, of ``one`` with ``two`` or (each once) of ``one`` with itself, with similarity ``num / den`` or more.

    The product is made a tile of rows by rows at a time, and summed over blocks of columns.  Rows go by size,
    so tiles whose sizes can't be similar are skipped.  Columns with one entry add nothing and are left out.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    col = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    new = tk.first_of_runs(col)
    shared = ~new | np.append(~new[1:], False)
    row, number = row[shared], np.cumsum(new[shared]) - 1
    back = np.argsort(row, kind="stable")  # by row, columns in order
    row, number = row[back], number[back].astype(np.int64)
    begin = np.searchsorted(row, np.arange(len(sets) + 1))
    one = one[np.argsort(size[one], kind="stable")]
    two = None if two is None else two[np.argsort(size[two], kind="stable")]

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = begin[rows + 1] - begin[rows]
        at = np.arange(int(n.sum())) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(rows)), n), number[at]

    other = one if two is None else two
    for a in range(0, len(one), TILE):
        left = one[a : a + TILE]
        r1, c1 = entries(left)
        for b in range(a if two is None else 0, len(other), TILE):
            right = other[b : b + TILE]
            low, high = sorted(((size[left[0]], size[left[-1]]), (size[right[0]], size[right[-1]])))
            if low[1] * den < high[0] * num:
                continue
            r2, c2 = entries(right)
            # only columns that both tiles have
            columns = np.intersect1d(c1, c2)
            k1, k2 = np.searchsorted(columns, c1), np.searchsorted(columns, c2)
            in1 = columns[np.minimum(k1, len(columns) - 1)] == c1 if len(columns) else np.zeros(len(c1), bool)
            in2 = columns[np.minimum(k2, len(columns) - 1)] == c2 if len(columns) else np.zeros(len(c2), bool)
            both = np.zeros((len(left), len(right)), dtype=np.int64)
            for lo in range(0, len(columns), COLUMNS):
                wide = min(COLUMNS, len(columns) - lo)
                m1, m2 = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
                use = in1 & (k1 >= lo) & (k1 < lo + wide)
                m1[r1[use], k1[use] - lo] = 1
                use = in2 & (k2 >= lo) & (k2 < lo + wide)
                m2[r2[use], k2[use] - lo] = 1
                both += (m1 @ m2.T).astype(np.int64)
            # the bound that the sizes give: |A & B| >= t / (1 + t) * (|A| + |B|)
            near = (both > 0) & (both * (den + num) >= (size[left][:, None] + size[right][None, :]) * num)
            if two is None and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            yield left[i], right[j]


def _product(num: int, den: int):
    def solve(square: bool, side: list[int], ids: list[int], copies: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(ids), kind="stable")
        order = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]] or not np.array_equal(sets[i], sets[order[n - 1]])]
        ids, side, copies = np.array(ids)[order], np.array(side)[order], np.array(copies)[order]
        sets = [sets[i] for i in order]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        degree = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        if len(one) and (square or len(two)):
            for i, j in links(sets, one, None if square else two, num, den):
                degree += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
                degree += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
                root = local_components(len(ids), np.concatenate([np.arange(len(ids)), i]), np.concatenate([root, j]))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(degree)], names=["doc_id", "near", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for *key, side, doc, copies, body in zip(*(batch.column(n).to_pylist() for n in ("block", "i", "j", "side", "doc_id", "copies", "body"))):
                if key != now and rows:
                    yield solve(now[1] == now[2], *map(list, zip(*rows)))
                    rows = []
                now = key
                rows.append((side, doc, copies, np.frombuffer(body, np.uint64)))
        if rows:
            yield solve(now[1] == now[2], *map(list, zip(*rows)))

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose sets of ``k``-word shingles have a Jaccard similarity of at least ``num / den``.

    Returns ``doc_id, n_shingles, component_id, n_links`` for every row: the size of the set, the smallest
    doc_id that links reach, and the number of other documents linked to directly, copies included.

    A text of fewer than ``k`` words is one shingle; a null, empty or blank text has none and links with
    nothing.  doc_id is a key; rows that repeat it with the same text count
    once, and each still gets its row.  A null doc_id gets a null component and 0 links.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    nameless = docs.where("doc_id is null")
    docs = docs.where("doc_id is not null")
    parts = parts_for(docs.count(), 4096)
    scanned = written(docs.mapInArrow(_scan(k, num, den, parts), _SCAN), "scan")
    sets = scanned.where("part < 0").mapInArrow(_summaries, "doc_id long, n_shingles long, f0 long, f1 long")
    classes = written(sets.where("n_shingles > 0").groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"), F.first("n_shingles").alias("n")), "classes")
    met = scanned.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_met, "u long, v long")
    members = written(_cut(connected(met), classes), "members")
    # texts move once and are not sorted, and nothing that grows with the input is broadcast: members are held a partition at a time
    rows = docs.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "root", "copies", "cut", "own", "text")
    rows = rows.mapInArrow(_rows(k), "doc_id long, root long, copies long, cut int, own int, body binary")
    if not members.where("cut > 1").isEmpty():
        # rows are shipped once for each part of their block, so blocks are made as small as can be
        rows = written(rows, "rows")
        wide = rows.where("cut > 1").select("doc_id", "body")
        finer = written(_cut(rare_blocks(wide, num, den), classes), "finer")
        rows = rows.where("cut = 1").unionByName(wide.join(finer, "doc_id"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"), F.when(F.col("own") > x, 1).otherwise(0).alias("side"))))
    rows = rows.select("doc_id", "root", "copies", "body", pair.alias("p")).select(F.col("root").alias("block"), "p.i", "p.j", "p.side", "doc_id", "copies", "body")
    tasks = rows.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    found = written(tasks.mapInArrow(_product(num, den), "doc_id long, near long, links long"), "links")
    roots = connected(found.select(F.col("doc_id").alias("u"), F.col("near").alias("v")))
    degree = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    label = classes.select("f0", "f1", "rep", "copies").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree.select(F.col("doc_id").alias("rep"), "links"), "rep", "left")
    label = label.select("f0", "f1", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.join(label, ["f0", "f1"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    lost = nameless.mapInArrow(_sizes(k), "doc_id long, n_shingles long").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(lost)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with their columns.

    Rows without a doc_id stay; rows that repeat a doc_id go or stay together.
    """
    docs, names = numbered(docs)
    key = names[doc_id]
    found = ngram_jaccard_join(docs, k, num, den, key, names[text])
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return restored(docs.join(gone.hint("shuffle_hash"), F.col(key).cast("long") == F.col("_gone"), "left_anti"), names)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tk.words(batch.column(1), lower=True):
                n = np.diff(tk.shingle_sets(w, k)[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.texts), pa.array(n)], names=["doc_id", "n_shingles"])

    return run


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words, similarity 85 hundredths, over all documents."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT node, b FROM r JOIN links ON a = seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE node = w.doc_id) AS component_id, (SELECT count(*) FROM links WHERE a = w.doc_id) AS n_links FROM w LEFT JOIN n USING (doc_id)
"""

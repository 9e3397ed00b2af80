"""Benchmark decontamination with DataFrame operations only.

The benchmark's windows of normalised words are a broadcast hash set keyed by a hash of the whole window.  A scan of
the documents splits each text into words once, hashes every word once and every window of word hashes, looks
the windows up, and compares a window that is found word for word.  Only verified windows leave the scan, so
what is shuffled are hits and one narrow row for each document.

A set that is too large to broadcast is met in a shuffle by the windows' hashes alone, without any text; what
meets is carried back to its documents and compared there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelloom.llm.shared import numbered, restored, written

#: Bytes of windows that are broadcast at most; beyond them the table is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # between words that are not yet lower-cased
#: In place of a window's hash, for a document's own row.  A window with this hash is told apart by its length.
_NO_WINDOW = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str | Column) -> Column:
    """An empty string, the words, and an empty string if the text does not end with a word."""
    return F.split(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)), _BREAK + "+")


def _number(words: str) -> Column:
    return (F.size(words) - 1 - F.when(F.element_at(words, -1) == "", 1).otherwise(0)).cast("long")


def benchmark_windows(benchmark: DataFrame, n: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``h`` (hash of the words' hashes), ``len``, ``win`` (the words) and ``items``.

    An item of fewer than ``n`` words, but not none, is one window.  A null item_id counts as an empty one.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.filter(_words(F.col(text)), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(n)))).alias("win"))
    wins = wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return wins.select(F.xxhash64(F.transform("win", lambda x: F.xxhash64(x))).alias("h"), F.size("win").alias("len"), "win", "items")


def _scanned(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``_id, _text, w, n_words`` and ``hs``: the hash of no window, and those of all windows of these lengths in turn."""
    split = docs.select("_id", F.xxhash64(F.coalesce("_t", F.lit(""))).alias("_text"), _words(F.col("_t")).alias("w")).select("*", _number("w").alias("n_words"))
    none = F.array().cast("array<bigint>")

    def of(each: Column, length: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - (length - 1))
        # the first of w is no word; a slice of an array would be made by going over all of it
        return F.when(F.col("n_words") >= length, F.transform(starts, lambda s: F.xxhash64(*(F.get(each, s + k) for k in range(length))))).otherwise(none)

    # the words' hashes are a lambda's argument, so that they are computed once and not for each window
    hashes = F.transform(F.array(F.transform("w", lambda x: F.xxhash64(x))), lambda each: F.concat(F.array(F.lit(_NO_WINDOW).cast("long")), *(of(each, n) for n in lengths)))
    return split.select("_id", "_text", "w", "n_words", F.element_at(hashes, 1).alias("hs"))


def _place(lengths: list[int]) -> tuple[Column, Column]:
    """The first word (from 1) and the length of the window at a place of ``hs``; 0 and 0 of no window."""
    at, size, before = F.lit(0), F.lit(0), F.lit(0)
    for length in lengths:
        here = F.col("pos") > before
        at, size = F.when(here, F.col("pos") - before).otherwise(at), F.when(here, F.lit(length)).otherwise(size)
        before = before + F.greatest(F.col("n_words").cast("int") - (length - 1), F.lit(0))
    return at.cast("int"), size


def _hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """A row for each distinct ``_id`` and text: ``_id, _text`` (its hash), ``rows, n_words, spans`` (word from 1, length) and ``items``."""
    windows = written(benchmark_windows(benchmark, n), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n of them at most
    size = windows.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 64 + 16 * F.size("items") + 16 * F.col("len")).alias("n")).first()["n"] or 0
    at, length = _place(lengths)
    scanned = _scanned(docs, lengths)
    if size <= BROADCAST_BYTES:
        # the hash of no window leads to the one row that each document gives
        each = docs.sparkSession.range(1).select(F.lit(_NO_WINDOW).cast("long").alias("h"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"))
        # outer, so that no filter on the windows is inferred and computed a second time before them
        table = F.broadcast(windows.unionByName(each).withColumnRenamed("len", "_len"))
        found = scanned.select("_id", "_text", "w", "n_words", F.posexplode_outer("hs").alias("pos", "h")).join(table, "h").withColumn("at", at).withColumn("len", length)
        found = found.where((F.col("_len") == F.col("len")) & (F.slice("w", F.col("at") + 1, F.col("len")) == F.col("win")))
    else:
        # windows by their hashes only; of documents where one is found the words are compared afterwards
        met = scanned.select("_id", "_text", "n_words", F.posexplode_outer("hs").alias("pos", "h")).where("pos > 0").select("_id", "_text", at.alias("at"), length.alias("len"), "h")
        met = written(met.join(windows.select("h", "len", "win", "items").hint("shuffle_hash"), ["h", "len"]).select(F.col("_id").alias("_i"), F.col("_text").alias("_x"), "at", "len", "win", "items"), "met")
        met = met.groupBy("_i", "_x").agg(F.collect_set(F.struct("at", "len", "win", "items")).alias("places"))
        back = scanned.drop("hs").join(met.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")), "left")
        own = F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"))
        found = back.select("_id", "_text", "w", "n_words", F.inline_outer(F.concat(F.array(own), F.coalesce("places", F.array()))))
        found = found.where((F.col("len") == 0) | (F.slice("w", F.col("at") + 1, F.col("len")) == F.col("win")))
    word = F.when(F.col("len") == 0, F.col("n_words"))
    found = found.select("_id", "_text", word.alias("n_words"), F.when(F.col("len") > 0, F.struct("at", "len")).alias("span"), F.when(F.col("len") > 0, F.col("items")).alias("items"))
    return found.groupBy("_id", "_text").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("rows"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered() -> Column:
    """How many words the sorted spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).cast("long").alias("sum"))

    return F.aggregate("spans", zero, add, lambda acc: acc["sum"])


def _judged(hits: DataFrame, percent: int) -> DataFrame:
    out = hits.withColumn("n_hit", _covered())
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    A word is hit if it lies in any occurrence of a benchmark window; a document is contaminated if at least
    ``percent`` hundredths of its words, and one, are hit.  ``items_sha256`` is of the ids of the items with
    occurring windows, sorted as strings and joined by commas.  A null text has no words.  Rows that repeat id and
    text get equal rows each; a null id is an id.  Other columns are ignored.  An empty table gives an empty
    result, an empty benchmark no hits.
    """
    hits = _hits(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_t")), benchmark, n)
    out = _judged(hits, percent).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, and without the hit words of the other rows (with the separators before them).

    Rows without hits are as they were.  The columns are those of ``docs``.
    """
    docs, names = numbered(docs)
    doc_id, text = names[doc_id], names[text]
    hits = _judged(_hits(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_t")), benchmark, n).where(F.size("spans") > 0), percent)
    hits = written(hits.select(F.col("_id").alias("_hit_id"), F.col("_text").alias("_hit_text"), F.when(~F.col("contaminated"), F.col("spans")).alias("_spans"), F.col("contaminated").alias("_out")), "hits")
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("_hit_text")), "left")
    # each piece is a word with the separators before it; the last may be separators only
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{_GAP}*[^{_GAP[1:-1]}]+|{_GAP}+$"), F.lit(0))
    rest = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["len"])))
    clean = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(rest, ""))
    return restored(joined.where("_out is null or not _out").withColumn(text, clean), names)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words of all benchmark items against all documents."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS win FROM bw),
ln AS (SELECT DISTINCT len(win) AS n FROM bi),
places AS (SELECT doc_id, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw CROSS JOIN ln),
hit AS (SELECT q.doc_id, q.i, q.n, bi.item_id FROM places q JOIN dw USING (doc_id) JOIN bi ON bi.win = dw.w[q.i:q.i + q.n - 1]),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

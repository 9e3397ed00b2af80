"""Quality rules: base counts, and Jensen-Shannon distance to language references.

Three scans of the texts, and no shuffle of texts:

1.  Each task names the words that make up at least 1/``rarest`` of its words of a language, from a summary of
    bounded size (Misra-Gries) that misses none of them.  A word with that share of the whole corpus has it
    in some task, so none is missed however rows are dealt.
2.  Exact counts of these words, and of character classes, per language over all documents.  A language's
    reference is its class histogram and the shares of its most frequent words.
3.  Per document the base counts, and the Jensen-Shannon distance (base 2, 0 to 1) of its class histogram
    and of its common-word histogram (the reference words, and all others as one) to its language's.

The references of each language with enough words hold its ``common`` most frequent words, and those that are as frequent
as the last of them: at most ``rarest`` words, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.llm import textkernel as tk
from parcelloom.llm.shared import numbered, release, restored, small_batches, written

#: Character classes by byte; of a code point outside ASCII its first byte counts.
LOWER, UPPER, DIGIT, SPACE, SYMBOL, STOP, PUNCT, OTHER, REST, CONTROL = range(10)
CLASSES = 10


def _classes() -> np.ndarray:
    t = np.full(256, PUNCT, dtype=np.int32)
    t[:32], t[127] = CONTROL, CONTROL
    t[32], t[9:14] = SPACE, SPACE
    t[48:58], t[65:91], t[97:123] = DIGIT, UPPER, LOWER
    for ch in b"#*$%&|<>":
        t[ch] = SYMBOL
    for ch in b".,":
        t[ch] = STOP
    t[0x80:0xC0], t[0xC0:] = REST, OTHER
    return t


CLASS = _classes()
#: Classes that count as characters in a distribution, and as code points within words.
COUNTED = [LOWER, UPPER, DIGIT, SYMBOL, STOP, PUNCT, OTHER, CONTROL]
IN_WORDS = [LOWER, UPPER, DIGIT, SYMBOL, STOP, PUNCT, OTHER, CONTROL]


@dataclass(frozen=True)
class QualityRules:
    """Parameters.  A distance rule holds for texts and references of its least length only."""

    min_words: int = 50
    repeat_percent: int = 50
    class_distance: float = 0.35
    class_min_chars: int = 200
    word_distance: float = 0.50
    word_min_words: int = 100
    rarest: int = 1000
    common: int = 50
    reference_min_words: int = 5000


def _languages(column: pa.Array) -> tuple[list, np.ndarray]:
    """The languages of a column, null last, and the place among them of each row's."""
    names = column.dictionary_encode()
    code = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
    return [*names.dictionary.to_pylist(), None], code


#: Words that a task's summary of a language holds.  A count is too low by at most 1/SUMMARY of all words.
SUMMARY = 8192


def _frequent(rarest: int):
    def reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([x for _, x in parts])).astype(np.int64)
        if len(n) > SUMMARY:
            n = n - np.partition(n, len(n) - SUMMARY - 1)[len(n) - SUMMARY - 1]
        return h[n > 0], n[n > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict = {}
        totals: dict = {}
        for batch in batches:
            names, code = _languages(batch.column(1))
            for w in tk.words(batch.column(2)):
                lang = code[w.lo : w.hi]
                for c in np.unique(lang).tolist():
                    own = w.hash[(lang == c)[w.doc]]
                    totals[names[c]] = totals.get(names[c], 0) + len(own)
                    parts = summary.setdefault(names[c], [])
                    parts.append(np.unique(own, return_counts=True))
                    if len(parts) >= 32:
                        summary[names[c]] = [reduced(parts)]
        for name, parts in summary.items():
            h, n = reduced(parts)
            h = h[(n + totals[name] // SUMMARY + 1) * rarest >= totals[name]]
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.astype(np.int64))], names=["lang", "hash"])

    return run


def _tables(words: list) -> dict:
    """Sorted hashes of each language's candidate words."""
    by: dict = {}
    for lang, h in words:
        by.setdefault(lang, set()).add(h)
    return {k: np.sort(np.array(list(v), np.int64).astype(np.uint64)) for k, v in by.items()}


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is in a sorted table, or the table's length."""
    if not len(table):
        return np.zeros(len(h), dtype=np.int64)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, i, len(table))


def _totals(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict = {}
        classes: dict = {}
        totals: dict = {}
        for batch in batches:
            names, code = _languages(batch.column(1))
            for w in tk.words(batch.column(2)):
                histogram = tk.byte_classes(w, CLASS, CLASSES)
                lang = code[w.lo : w.hi]
                for c in np.unique(lang):
                    name = names[c]
                    table = tables.value.get(name, np.zeros(0, np.uint64))
                    own = w.hash if len(names) == 2 else w.hash[(lang == c)[w.doc]]
                    n = np.bincount(_place(table, own), minlength=len(table) + 1)[: len(table)]
                    words[name] = words.get(name, 0) + n
                    totals[name] = totals.get(name, 0) + len(own)
                    classes[name] = classes.get(name, 0) + histogram[lang == c].sum(axis=0)
        rows = []
        for name, n in totals.items():
            rows.append((name, 0, 0, int(n)))
            rows += [(name, 1, c, int(x)) for c, x in enumerate(classes[name])]
            table = tables.value.get(name, np.zeros(0, np.uint64)).astype(np.int64)
            rows += [(name, 2, int(h), int(x)) for h, x in zip(table, np.broadcast_to(words[name], len(table)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["lang", "kind", "item", "n"])

    return run


def references(docs: DataFrame, rules: QualityRules) -> dict:
    """For each language with enough words: its class shares, its common words' hashes (sorted) and their shares."""
    spark = docs.sparkSession
    words = written(docs.mapInArrow(_frequent(rules.rarest), "lang string, hash long").distinct(), "frequent")
    # a task names little more than ``rarest`` words of a language
    seen = spark.sparkContext.broadcast(_tables([(r["lang"], r["hash"]) for r in words.toLocalIterator()]))
    sums = written(docs.mapInArrow(_totals(seen), "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "totals")
    size = sums.where("kind = 0").select(F.col("lang").alias("l0"), F.col("n").alias("words")).where(F.col("words") >= rules.reference_min_words)
    rows = sums.join(F.broadcast(size), F.col("lang").eqNullSafe(F.col("l0")))
    shares = rows.where(f"kind = 1 or kind = 2 and n * {rules.rarest} >= words").collect()
    out: dict = {}
    for lang in {r["lang"] for r in shares}:
        own = [r for r in shares if r["lang"] == lang]
        total = own[0]["words"]
        classes = np.zeros(CLASSES)
        for r in own:
            if r["kind"] == 1:
                classes[r["item"]] = r["n"]
        common = [(int(np.int64(r["item"]).astype(np.uint64)), r["n"]) for r in own if r["kind"] == 2]
        least = min(sorted((n for _, n in common), reverse=True)[: rules.common], default=0)
        common = sorted((h, n) for h, n in common if n >= least)
        share = np.array([n for _, n in common] + [total - sum(n for _, n in common)], dtype=float) / total
        classes = classes[COUNTED]
        out[lang] = (classes / max(1.0, classes.sum()), np.array([h for h, _ in common], np.uint64), share)
    seen.unpersist()
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of ``p`` (shares or counts) to ``q``; 1 for a row of zeros."""
    total = p.sum(axis=-1, keepdims=True)
    p = p / np.where(total == 0, 1, total)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.where(total[..., 0] == 0, 1.0, np.sqrt(np.clip((left + right) / 2, 0, 1)))


def base_counts(w: tk.Words) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and classes by byte."""
    classes = tk.byte_classes(w, CLASS, CLASSES)
    h, at = tk.windows(w, 3)
    at = at[tk.repeated(w.doc[at], h)]
    line_doc, line_hash = tk.lines(w)
    order = np.sort(line_doc.astype(np.uint64) << np.uint64(52) | line_hash >> np.uint64(12))
    again = (order[~tk.first_of_runs(order)] >> np.uint64(52)).astype(np.int64)
    return {
        "n_words": w.counts(), "word_chars": classes[:, IN_WORDS].sum(axis=1), "n_symbols": classes[:, SYMBOL],
        "n_dup_lines": np.bincount(again, minlength=w.texts), "n_repeat_words": np.bincount(w.doc[tk.covered(len(w.doc), at, 3)], minlength=w.texts), "classes": classes,
    }


_OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")] + [T.StructField(n, T.DoubleType()) for n in ("class_distance", "word_distance")])


def _verdicts(w: tk.Words, langs: list, code: np.ndarray, refs: dict, rules: QualityRules) -> dict[str, np.ndarray]:
    """Base counts, verdicts and distances of a group of texts; ``code`` are places in ``langs``."""
    b = base_counts(w)
    n = b["n_words"]
    failed = (n < rules.min_words) | (100 * b["n_repeat_words"] > rules.repeat_percent * n)
    far = {"class": np.full(w.texts, np.nan), "word": np.full(w.texts, np.nan)}
    for c in np.unique(code):
        if (ref := refs.get(langs[c])) is None:
            continue
        mine = np.flatnonzero(code == c)
        shares, table, common = ref
        counted = b["classes"][mine][:, COUNTED]
        long = counted.sum(axis=1) >= rules.class_min_chars
        far["class"][mine[long]] = js_distance(counted[long].astype(float), shares)
        long = mine[n[mine] >= rules.word_min_words]
        number = np.full(w.texts, -1)
        number[long] = np.arange(len(long))
        own = number[w.doc] >= 0
        cell = number[w.doc[own]] * len(common) + _place(table, w.hash[own])
        far["word"][long] = js_distance(np.bincount(cell, minlength=len(long) * len(common)).reshape(len(long), len(common)).astype(float), common)
    kept = ~failed & ~(far["class"] > rules.class_distance) & ~(far["word"] > rules.word_distance)
    return {**{k: v for k, v in b.items() if k != "classes"}, "base_failed": failed, "kept": kept, "class_distance": far["class"], "word_distance": far["word"]}


def _judge(refs, rules: QualityRules):
    """Verdicts of batches of ``doc_id, lang, text``."""
    names = _OUT.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = _languages(batch.column(1))
            for w in tk.words(batch.column(2)):
                found = _verdicts(w, langs, code[w.lo : w.hi], refs.value, rules)
                columns = {k: pa.array(v.astype(np.int64) if v.dtype.kind in "iu" else v, from_pandas=True) for k, v in found.items()}
                columns["doc_id"] = batch.column(0).slice(w.lo, w.texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([columns[x] for x in names], names=names)
        release()

    return run


def _is_good(refs, rules: QualityRules):
    """A function of texts and languages: which are kept."""

    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        langs, code = _languages(lang)
        out = [np.zeros(0, bool)]
        for w in tk.words(text):
            out.append(_verdicts(w, langs, code[w.lo : w.hi], refs.value, rules)["kept"])
        return pa.array(np.concatenate(out))

    return run


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and a verdict for every row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance``.  Rows are judged one by one, so repeated rows get equal results.  A
    null, empty or blank text has no words and fails the base rules.  A null language is a language of its
    own.  A distance is null, and decides nothing, where the text or its language's reference is too short
    (see ``QualityRules``).  Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, rules))
    return docs.mapInArrow(_judge(refs, rules), _OUT)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, without a shuffle.

    Only texts and languages go to Python and only verdicts come back.  Rows are judged one by one as in
    ``quality_rules``: null, empty and blank texts go, a null doc_id or language changes nothing, repeated rows stay
    or go together, extra columns stay under any name, and an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs, names = numbered(docs)
    fixed = docs.select(F.col(names[doc_id]).cast("string").alias("doc_id"), F.col(names[lang]).cast("string").alias("lang"), F.col(names[text]).cast("string").alias("text"))
    refs = spark.sparkContext.broadcast(references(fixed, rules))
    good = F.arrow_udf(_is_good(refs, rules), "boolean")
    return restored(docs.where(good(F.col(names[text]).cast("string"), F.col(names[lang]).cast("string"))), names)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Production parameters over all documents; distances to six places."""
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


#: Each class of ``COUNTED``, in order, as what it is not.
_NOT = ("[^a-z]", "[^A-Z]", "[^0-9]", "[^#*$%&|<>]", "[^.,]", r"[^!-~]|[a-zA-Z0-9#*$%&|<>.,]", r"[\x00-\x7F]", r"[^\x00-\x08\x0E-\x1F\x7F]")
_JS = "sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)))"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT r, lang, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
size AS (SELECT lang, sum(len(w)) AS words FROM d GROUP BY lang HAVING sum(len(w)) >= 5000),
c AS (SELECT r, lang, unnest(range({len(_NOT)})) AS k, unnest([{", ".join(f"length(regexp_replace(text, '{x}', '', 'g'))" for x in _NOT)}]) AS n FROM d),
class_ref AS (SELECT lang, k, sum(n) / greatest(1, sum(sum(n)) OVER (PARTITION BY lang))::DOUBLE AS q FROM c GROUP BY lang, k),
long_c AS (SELECT *, n / sum(n) OVER (PARTITION BY r)::DOUBLE AS p FROM c QUALIFY sum(n) OVER (PARTITION BY r) >= 200),
class_far AS (SELECT r, {_JS} AS far FROM long_c c JOIN class_ref x ON c.k = x.k AND c.lang IS NOT DISTINCT FROM x.lang JOIN size s ON c.lang IS NOT DISTINCT FROM s.lang GROUP BY r),
word_n AS (SELECT lang, word, count(*) AS n, rank() OVER (PARTITION BY lang ORDER BY count(*) DESC) AS place FROM pos GROUP BY lang, word),
word_ref AS (SELECT x.lang, word, n / words::DOUBLE AS q FROM word_n x JOIN size s ON x.lang IS NOT DISTINCT FROM s.lang WHERE place <= 50 AND n * 1000 >= words),
long_d AS (SELECT r, d.lang, len(w) AS n FROM d JOIN size s ON d.lang IS NOT DISTINCT FROM s.lang WHERE len(w) >= 100),
own AS (SELECT r, word, count(*) AS n FROM pos GROUP BY r, word),
cell AS (SELECT d.r, coalesce(own.n, 0) / d.n::DOUBLE AS p, x.q FROM long_d d JOIN word_ref x ON d.lang IS NOT DISTINCT FROM x.lang LEFT JOIN own ON own.r = d.r AND own.word = x.word),
cells AS (SELECT * FROM cell UNION ALL SELECT d.r, 1 - coalesce(sum(p), 0), 1 - coalesce(sum(q), 0) FROM long_d d LEFT JOIN cell USING (r) GROUP BY d.r),
word_far AS (SELECT r, {_JS} AS far FROM cells GROUP BY r),
three AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE c IS NOT NULL),
hit AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS x FROM three WHERE n > 1) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(line.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, class_far.far AS c, word_far.far AS f FROM d LEFT JOIN line USING (r) LEFT JOIN hit USING (r) LEFT JOIN class_far USING (r) LEFT JOIN word_far USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(c <= 0.35, true) AND coalesce(f <= 0.5, true) AS kept, round(c, 6) AS class_distance, round(f, 6) AS word_distance FROM b
"""

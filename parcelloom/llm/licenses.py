"""License scans by a positional index of rare words.

1.  One scan counts in how many of all documents each word of the license templates occurs: the index's IDF.
2.  A second scan finds the license phrases, and for each text the templates that it has enough words of.  For
    these the text's rarest license words are looked up in the index; each place in the text and posting
    (template, position) gives the place where the template would begin, and places on which several different
    words agree are candidates.  A candidate counts if enough of the template's words stand where it says and
    all of the template's mandatory phrases are found, a few words off at most.  Templates that the rarest words
    don't find word for word (they may all belong to another notice) are looked up again with all of their words.

No shuffle of texts; what is broadcast is the templates' index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.llm import textkernel as tk

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A license notice: its label, its words, and phrases without which it isn't that license."""

    label: str
    text: str
    mandatory: tuple[str, ...]


TEMPLATES = (
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)


def _hashes(text: str) -> np.ndarray:
    return next(tk.words(pa.array([text]), tk.ALNUM, lower=True)).hash


class Index:
    """Templates' words with their postings, and which templates a text's words allow."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, rarest: int = 12, agree: int = 3, coverage: float = 0.8, slack: int = 3) -> None:
        self.rarest, self.agree, self.coverage, self.slack = rarest, agree, coverage, slack
        self.labels = [t.label for t in templates]
        self.words = [_hashes(t.text) for t in templates]
        self.mandatory = [[self._placed(w, _hashes(m)) for m in t.mandatory] for t, w in zip(templates, self.words)]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.number = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, numbers in enumerate(self.number):
            for q, v in enumerate(numbers):
                self.postings.setdefault(int(v), []).append((t, q))
        self.holds = np.zeros((len(self.vocabulary), len(templates)), dtype=np.int64)
        for t, numbers in enumerate(self.number):
            self.holds[numbers, t] = 1
        # shares that `scan` accepts, short of all words: so many words may be missing
        missing = [sum(k / len(n) >= coverage for k in range(len(n))) for n in self.number]
        self.needs = np.array([max(1, len(set(n.tolist())) - m) for n, m in zip(self.number, missing)])
        self.phrases = [(_hashes(p), label) for p, label in phrases.items()]
        self.rank = np.arange(len(self.vocabulary))

    @staticmethod
    def _placed(words: np.ndarray, phrase: np.ndarray) -> tuple[int, np.ndarray]:
        for q in range(len(words) - len(phrase) + 1):
            if np.array_equal(words[q : q + len(phrase)], phrase):
                return q, phrase
        raise ValueError("a mandatory phrase must be part of its template")

    def weigh(self, documents: int, frequency: dict[int, int]) -> None:
        """Rank the words by IDF, the rarest first."""
        idf = np.array([math.log((1 + documents) / (1 + frequency.get(v, 0))) for v in range(len(self.vocabulary))])
        self.rank = np.empty(len(idf), dtype=np.int64)
        self.rank[np.lexsort((np.arange(len(idf)), -idf))] = np.arange(len(idf))

    def known(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Where license words stand, and their numbers."""
        i = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[i] == w.hash)
        return at, i[at]

    def scan(self, text: np.ndarray, at: np.ndarray, number: np.ndarray, templates: np.ndarray) -> dict[int, float]:
        """Verified templates of one text (its words' hashes, its license words' places and numbers), with their coverage."""
        rank = self.rank[number]
        present = np.unique(rank)
        use = rank <= present[min(self.rarest, len(present)) - 1]
        votes: dict[tuple[int, int], set[int]] = {}
        allowed = set(templates.tolist())
        for p, v in zip(at[use].tolist(), number[use].tolist()):
            for t, q in self.postings[v]:
                if t in allowed:
                    votes.setdefault((t, p - q), set()).add(v)
        out: dict[int, float] = {}
        for (t, begin), words in votes.items():
            if len(words) < min(self.agree, self.rarest, len(set(self.number[t].tolist()))):
                continue
            template = self.words[t]
            lo, hi = max(0, -begin), min(len(template), len(text) - begin)
            share = float((text[begin + lo : begin + hi] == template[lo:hi]).sum()) / len(template)
            if share >= self.coverage and share > out.get(t, 0) and all(self._near(text, begin + q, m) for q, m in self.mandatory[t]):
                out[t] = share
        for t in allowed:
            if out.get(t, 0) < 1:
                out |= self._everywhere(text, at, number, t, out.get(t, 0))
        return out

    def _everywhere(self, text: np.ndarray, at: np.ndarray, number: np.ndarray, t: int, least: float) -> dict[int, float]:
        """The template, if it stands anywhere with a coverage above ``least``: all of its words are counted where they are in place."""
        template, found = self.words[t], {}
        last = len(template) - 1
        placed = np.zeros(len(text) + last, dtype=np.int32)  # by the place where the template begins, from -last
        for q, v in enumerate(self.number[t].tolist()):
            placed[at[number == v] + (last - q)] += 1
        for i in np.flatnonzero(placed >= max(1, math.floor(self.coverage * len(template)))).tolist():
            share = float(placed[i]) / len(template)
            if share >= self.coverage and share > found.get(t, least) and all(self._near(text, i - last + q, m) for q, m in self.mandatory[t]):
                found[t] = share
        return found

    def _near(self, text: np.ndarray, at: int, phrase: np.ndarray) -> bool:
        return any(p >= 0 and np.array_equal(text[p : p + len(phrase)], phrase) for p in range(at - self.slack, at + self.slack + 1))


def _frequencies(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(len(index.value.vocabulary), np.int64), 0
        for batch in batches:
            documents += len(batch)
            for w in tk.words(batch.column(0), tk.ALNUM, lower=True):
                at, number = index.value.known(w)
                pairs = np.unique(w.doc[at] * len(total) + number)
                total += np.bincount(pairs % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int64)), pa.array(np.append(documents, total))], names=["word", "n"])

    return run


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        for batch in batches:
            for w in tk.words(batch.column(1), tk.ALNUM, lower=True):
                first = w.first()
                n_base = np.zeros(w.texts, np.int64)
                low, high = np.full(w.texts, np.iinfo(np.int64).max), np.full(w.texts, -1)
                base: dict[int, set] = {}
                for phrase, label in index.phrases:
                    at = np.flatnonzero(w.hash[: len(w.hash) - len(phrase) + 1] == phrase[0]) if len(w.hash) >= len(phrase) else np.zeros(0, np.int64)
                    for k in range(1, len(phrase)):
                        at = at[(w.hash[at + k] == phrase[k]) & (w.doc[at + k] == w.doc[at])]
                    doc = w.doc[at]
                    n_base += np.bincount(doc, minlength=w.texts)
                    np.minimum.at(low, doc, at - first[doc])
                    np.maximum.at(high, doc, at - first[doc])
                    for d in np.unique(doc).tolist():
                        base.setdefault(d, set()).add(label)
                at, number = index.known(w)
                has = np.zeros((w.texts, len(index.vocabulary)), dtype=np.int64)
                has[w.doc[at], number] = 1
                allowed = has @ index.holds >= index.needs
                labels = {d: set(x) for d, x in base.items()}
                score = np.where(n_base > 0, 0.5, 0.0)
                for d in np.flatnonzero(allowed.any(axis=1)).tolist():
                    own = slice(*np.searchsorted(at, (first[d], first[d + 1])))
                    found = index.scan(w.hash[first[d] : first[d + 1]], at[own] - first[d], number[own], np.flatnonzero(allowed[d]))
                    for t, share in found.items():
                        labels.setdefault(d, set()).add(index.labels[t])
                        score[d] = max(score[d], share)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.lo, w.texts), pa.array(w.counts()), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(base.get(d, ()))) for d in range(w.texts)]), pa.array([",".join(sorted(labels.get(d, ()))) for d in range(w.texts)]), pa.array(score),
                ], names=_OUT.fieldNames())

    return run


def license_scan(docs: DataFrame, index: Index | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """License phrases and notices of every row.

    Returns ``doc_id, n_words, n_base`` (places of all phrases), ``first_word, last_word`` (their smallest and
    largest start; null without any), ``base_labels``, ``labels`` (the templates' too; distinct, sorted, joined by
    commas) and ``score``: the share of the best verified template's words that stand in place, at least 0.5 with any
    phrase, else 0.  A null or empty text has no words.  Rows are judged one by one: repeated rows and null ids get
    rows of their own.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = index or Index()
    plain = spark.sparkContext.broadcast(index)
    sums = Counter({r["word"]: r["n"] for r in docs.select("text").mapInArrow(_frequencies(plain), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()})
    index.weigh(sums.pop(-1, 0), sums)
    plain.unpersist()
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(index)), _OUT)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """The phrases and templates of this module over all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rows(rows) -> str:
    """SQL of rows of numbers, words and lists of words; all of them are of this module."""
    one = lambda x: str(x) if isinstance(x, int) else f"'{x}'" if isinstance(x, str) else f"[{', '.join(map(one, x))}]"
    return "VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def _sql(templates=TEMPLATES, phrases=PHRASES, coverage: float = 0.8, slack: int = 3) -> str:
    words = [(t.label, len(t.text.split()), q, w) for t in templates for q, w in enumerate(t.text.split())]
    starts = lambda t, m: next(q for q in range(len(t)) if t[q : q + len(m)] == m)
    must = [(t.label, len(t.mandatory), k, starts(t.text.split(), m.split()), m.split()) for t in templates for k, m in enumerate(t.mandatory)]
    return rf"""
WITH t(label, size, q, word) AS ({_rows(words)}),
must(label, all_of, k, q, words) AS ({_rows(must)}),
phrase(label, words) AS ({_rows((label, p.split()) for p, label in phrases.items())}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
base AS (SELECT r, label, p FROM pos JOIN phrase ON word = words[1] JOIN d USING (r) WHERE w[p + 1:p + len(words)] = words),
placed AS (SELECT r, label, p - q AS i, count(*) / size::DOUBLE AS share FROM pos JOIN t USING (word) GROUP BY r, label, p - q, size HAVING count(*) / size::DOUBLE >= {coverage}::DOUBLE),
stands AS (SELECT r, label, all_of, k, p - q AS i FROM pos JOIN must ON word = words[1] JOIN d USING (r) WHERE w[p + 1:p + len(words)] = words),
found AS (SELECT a.r, a.label, a.i, share FROM placed a JOIN stands b ON a.r = b.r AND a.label = b.label AND abs(a.i - b.i) <= {slack} GROUP BY a.r, a.label, a.i, share, all_of HAVING count(DISTINCT k) = all_of),
label AS (SELECT r, label, 0.5::DOUBLE AS score, true AS is_base FROM base UNION ALL SELECT r, label, share, false FROM found),
places AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM base GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM label GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN labels USING (r)
"""


OP10_SQL = _sql()

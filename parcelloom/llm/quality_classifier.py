"""Quality classifier by positive-unlabelled learning.

Documents known to be good are trusted positives; all other text is unlabelled, a mixture of good and bad.  A
logistic model over binned text statistics minimises the non-negative unbiased risk

    pi * R+(P)  +  max(0, R-(U) - pi * R-(P))

with the class prior pi estimated from how the unlabelled text exceeds the positives where a first model
(positives against unlabelled) scores low.  Label 0 is never used.

Statistics are computed for every document, and bin edges are quantiles over all of them.  The model is fitted on the
driver on ``positives`` and ``unlabelled`` rows at most, those with the least hash of their id.  The prior is estimated
from all training rows: the first models score each of them, and histograms of the scores come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.llm import textkernel as tk
from parcelloom.llm.quality_rules import COUNTED, SPACE, base_counts
from parcelloom.llm.shared import written

FEATURES = [
    "log_words", "word_length", "symbols", "repeats", "dup_lines", "distinct", "top_word", "line_words", "spaces",
    *(f"class_{c}" for c in COUNTED),
]

#: Bins of the scores' histograms in a unit of log odds.
BINS_A_UNIT = 1024


@dataclass(frozen=True)
class PuParameters:
    """Parameters of the fit; ``positives`` and ``unlabelled`` bound its rows."""

    positives: int = 20_000
    unlabelled: int = 40_000
    bins: int = 16
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    least_tail: float = 0.25


def text_features(w: tk.Words) -> np.ndarray:
    """A row of ``FEATURES`` for each text; of an empty text all are 0."""
    b = base_counts(w)
    n = b["n_words"].astype(float)
    some, chars = np.maximum(n, 1), np.maximum(b["word_chars"], 1).astype(float)
    packed = np.sort(w.doc.astype(np.uint64) << np.uint64(52) | w.hash >> np.uint64(12))
    begins = np.flatnonzero(tk.first_of_runs(packed))
    owner = (packed[begins] >> np.uint64(52)).astype(np.int64)
    top = np.zeros(w.texts, np.int64)
    np.maximum.at(top, owner, np.diff(np.append(begins, len(packed))))
    lines = np.maximum(np.bincount(tk.lines(w)[0], minlength=w.texts), 1)
    size = np.maximum(np.diff(w.offsets), 1)
    columns = [np.log1p(n), b["word_chars"] / some, b["n_symbols"] / chars, b["n_repeat_words"] / some, b["n_dup_lines"] / lines, np.bincount(owner, minlength=w.texts) / some, top / some, n / lines, b["classes"][:, SPACE] / size]
    columns += [b["classes"][:, c] / chars for c in COUNTED]
    out = np.stack(columns, axis=1)
    out[n == 0] = 0
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in tk.words(batch.column(1)):
            x = text_features(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.texts), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["doc_id", *FEATURES])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Cumulative indicators: whether each feature exceeds each of its edges."""
    return np.concatenate([x[:, [i]] > e for i, e in enumerate(edges)], axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, p: PuParameters) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam: of the non-negative risk, or without a prior of positives against unlabelled."""
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        d = d / len(x)
        return np.append(d.astype(np.float32) @ x, d.sum())

    for t in range(1, p.steps + 1):
        sp, su = _sigmoid(positive @ w[:-1].astype(np.float32) + w[-1]), _sigmoid(unlabelled @ w[:-1].astype(np.float32) + w[-1])
        if prior is None:
            g = 0.5 * gradient(positive, sp - 1) + 0.5 * gradient(unlabelled, su)
        else:
            # the logistic loss of class -1 is -log(1 - s), its gradient s
            negative = -np.log(np.maximum(1 - su, 1e-9)).mean() + prior * np.log(np.maximum(1 - sp, 1e-9)).mean()
            g = gradient(unlabelled, su) - prior * gradient(positive, sp)
            g = prior * gradient(positive, sp - 1) + g if negative >= 0 else -g
        g[:-1] += max(p.decay, 0.5 / len(positive)) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least_tail: float) -> float:
    """The share of positives in the unlabelled, from the scores of either.

    Below any threshold the unlabelled hold ``pi`` times the positives' share, and negatives; the threshold that
    shows the most negatives decides.  At least ``least_tail`` of the positives must lie above it.
    """
    t, at = np.unique(np.concatenate([positive, unlabelled]), return_inverse=True)
    counts = (np.bincount(x, minlength=len(t)) for x in (at[: len(positive)], at[len(positive) :]))
    return prior_of_counts(*counts, least_tail)


def prior_of_counts(positive: np.ndarray, unlabelled: np.ndarray, least_tail: float) -> float:
    """``class_prior`` from how many positives and unlabelled have each score, the lowest first."""
    below_p, below_u = (np.cumsum(n) / n.sum() for n in (positive, unlabelled))
    use = 1 - below_p >= least_tail
    if not use.any():
        return 1 - 1e-3
    negatives = ((below_u - below_p)[use] / (1 - below_p)[use]).max()
    return float(np.clip(1 - negatives, 0.01, 1 - 1e-3))


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(binned(x, self.edges) @ self.weights.astype(np.float32) + self.bias).astype(float)


def _bins(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, first = models.value
        for batch in batches:
            x = binned(np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1), edges) if len(batch) else np.zeros((0, sum(len(e) for e in edges)), np.float32)
            half = batch.column("half").to_numpy()
            z = np.where(half == 0, x @ first[1][0] + first[1][1], x @ first[0][0] + first[0][1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.floor(np.clip(z, -30, 30) * BINS_A_UNIT).astype(np.int32))], names=["doc_id", "bin"])

    return run


def fit(features: DataFrame, positives: DataFrame, p: PuParameters = PuParameters()) -> Model:
    """A model from the ``features`` of training documents and the ids of the positive ones."""
    ranks = [i / p.bins for i in range(1, p.bins)]
    cuts = features.agg(*(F.percentile_approx(c, ranks, 2000).alias(c) for c in FEATURES)).first()
    edges = [np.unique(np.array(cuts[c] if cuts[c] else [0.0])) for c in FEATURES]

    half = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int").alias("half")

    def sample(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        # about 2n rows pass a cut of the hash; the n least of them come to the driver
        total, place = df.count(), F.xxhash64(F.lit(5), "doc_id")
        if total > 2 * n:
            df = df.where(F.pmod(place, F.lit(1 << 30)) < 2 * n * (1 << 30) // total)
        rows = df.orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id").limit(n).select(half, *FEATURES).toPandas()
        return binned(rows[FEATURES].to_numpy(dtype=float), edges), rows["half"].to_numpy()

    positives = positives.select("doc_id").distinct()
    known, known_half = sample(features.join(positives, "doc_id"), p.positives)
    text, text_half = sample(features, p.unlabelled)
    wide = sum(len(e) for e in edges)
    if not len(known) or not len(text):
        return Model(edges, np.zeros(wide), 0.0, 0.5)
    # a first model is fitted on one half and looks at the other, so that it cannot know positives by heart
    first = []
    for h in (0, 1):
        own = [x[of == h] if (of == h).any() else x for x, of in ((known, known_half), (text, text_half))]
        w, b = _fit(*own, None, p)
        first.append((w.astype(np.float32), b))
    bins = features.select("doc_id", half, *FEATURES).mapInArrow(_bins(features.sparkSession.sparkContext.broadcast((edges, first))), "doc_id long, bin int")
    bins = bins.join(positives.withColumn("known", F.lit(1)), "doc_id", "left").groupBy("bin").agg(F.count("*").alias("n"), F.count("known").alias("known")).toPandas().sort_values("bin")
    prior = prior_of_counts(bins["known"].to_numpy(), bins["n"].to_numpy(), p.least_tail)
    w, b = _fit(known, text, prior, p)
    return Model(edges, w, b, prior)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, threshold: float = 0.3, p: PuParameters = PuParameters(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Rows whose ``crc32(doc_id as text) mod held_out_of`` is 0 are held out: neither their labels nor their texts are
    learned from.  ``labels`` has ``doc_id`` and ``quality``; any row with 1 makes its document a positive.  A null or
    empty text has features of 0 and is scored like any other; a null doc_id counts as an empty text and is held out;
    repeated rows get equal rows each.  Without positives every score is 0.5.  Other columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES)
    features = written(docs.mapInArrow(_features, fields), "features")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % held_out_of == 0
    model = fit(features.where(~held), labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")), p)
    scores = features.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return scores.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def op6_pu_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents, with positives from ``labels``."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

import numpy as np
import pyarrow as pa
import pytest

from parcelloom.llm import quality_classifier as qc
from parcelloom.llm import quality_rules as qr
from parcelloom.llm import textkernel as tk
from tests.llm import brute

GOOD = ["the cat and the dog went to the park, and they saw the sun. " + " ".join(f"{a}{b}" for a in ("walk", "talk", "sing", "read") for b in ("ed", "s", "ing", f"er{i}")) + " the end of the day and of it." for i in range(40)]
LONG_GOOD = [(g.replace("walk", f"w{i}alk") + " " + g.replace("talk", f"t{i}alk").replace("sing", f"s{i}ing") + " " + " ".join(f"the n{i}o{j} and" for j in range(60))) for i, g in enumerate(GOOD)]
BAD = [" ".join(f"%%%$$$###{i}{j}***" for j in range(150)) for i in range(4)]


def test_base_counts(spark):
    got = {r["doc_id"]: r for r in qr.quality_rules(brute.documents(spark)).collect()}
    for i, t in enumerate(brute.TEXTS):
        want = brute.base_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["kept"] or not r["base_failed"])


def test_junk_goes_and_clean_text_stays(spark):
    df = brute.documents(spark, LONG_GOOD + BAD).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en"))
    rules = qr.QualityRules(reference_min_words=1000)
    a, b = (qr.quality_rules(df.repartition(n), rules) for n in (1, 4))
    rows = {r["doc_id"]: r for r in a.collect()}
    assert rows == {r["doc_id"]: r for r in b.collect()}  # however rows are dealt
    assert all(rows[i]["kept"] for i in range(len(LONG_GOOD))) and not any(rows[len(LONG_GOOD) + i]["kept"] for i in range(len(BAD)))
    kept = qr.keep_good(df, rules)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(LONG_GOOD)))


def test_distances_against_a_plain_version(spark):
    from collections import Counter

    rules = qr.QualityRules(reference_min_words=1, rarest=50, common=5)
    texts = LONG_GOOD[:6]
    df = brute.documents(spark, texts).drop("lang").withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    all_words = Counter(w for t in texts for w in brute.spaced(t))
    total = sum(all_words.values())
    h = {w: int(next(tk.words(pa.array([w]))).hash[0]) for w in all_words}
    top = sorted((w for w, n in all_words.items() if n * 50 >= total), key=lambda w: (-all_words[w], np.uint64(h[w]).astype(np.int64)))[:5]
    q = np.array([all_words[w] for w in top] + [total - sum(all_words[w] for w in top)]) / total
    for r in qr.quality_rules(df, rules).collect():
        w = Counter(brute.spaced(texts[r["doc_id"]]))
        p = np.array([w[x] for x in top] + [sum(w.values()) - sum(w[x] for x in top)], dtype=float)
        assert r["word_distance"] == pytest.approx(float(qr.js_distance(p[None, :], q)[0]))


def test_js_distance_bounds():
    assert qr.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1.0)
    assert qr.js_distance(np.array([[2.0, 2.0]]), np.array([0.5, 0.5]))[0] == pytest.approx(0.0)
    assert qr.js_distance(np.zeros((1, 2)), np.array([0.5, 0.5]))[0] == 1.0


def test_empty_tables(spark):
    none = brute.documents(spark, [])
    assert qr.quality_rules(none).count() == 0 and qr.keep_good(none).count() == 0
    assert qc.quality_scores(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_positive_unlabelled_learning(spark):
    texts = LONG_GOOD * 4 + BAD * 6 + [None, ""]
    df = brute.documents(spark, texts)
    n = len(LONG_GOOD) * 4
    labels = spark.createDataFrame([(i, 1 if i < n else 0, 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    p = qc.PuParameters(steps=150)
    rows = {r["doc_id"]: r for r in qc.quality_scores(df, labels, p=p).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    good, bad = [rows[i]["score"] for i in range(n)], [rows[i]["score"] for i in range(n, n + 24)]
    assert min(good) > max(bad)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    # labels of held-out rows, and label 0, are not learned from
    other = labels.where("quality = 1 and crc32(cast(doc_id as string)) % 5 <> 0")
    again = {r["doc_id"]: r["score"] for r in qc.quality_scores(df, other, p=p).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}
    none = qc.quality_scores(df, labels.where("quality > 1"), p=p)
    assert {r["score"] for r in none.collect()} == {0.5}


def test_odd_rows_are_scored(spark):
    """Null and repeated ids, very long texts and columns with the operator's own names."""
    texts = LONG_GOOD + BAD + [None, "", brute.LONG, LONG_GOOD[0], BAD[0], brute.LONG]
    n = len(LONG_GOOD) + len(BAD)
    ids = [*range(n + 3), None, None, n + 2]
    df = brute.documents(spark, texts, ids)
    for name in ("score", "held_out", "half", "predicted", "quality"):
        df = df.withColumn(name, df["shard"])
    labels = spark.createDataFrame([(i, 1) for i in range(0, len(LONG_GOOD), 2)] + [(0, 1), (None, 1), (1, None), (10**6, 1)], "doc_id long, quality int")
    rows = qc.quality_scores(df, labels, p=qc.PuParameters(steps=80)).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r["score"])
    assert len(of[n + 2]) == 2 and len(set(of[n + 2])) == 1 and of[n] == of[n + 1]


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert qc.class_prior(p, u, 0.25) == pytest.approx(0.7, abs=0.06)


def test_the_prior_counts_all_rows(spark):
    # 1110 of 3000 rows are good, and far fewer are fitted on
    rows = [(i, *[float(i % 1000 < 370) * (k + 1) for k in range(len(qc.FEATURES))]) for i in range(3000)]
    features = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} double" for c in qc.FEATURES)).repartition(3)
    positives = features.where("doc_id % 1000 < 370").select("doc_id")
    model = qc.fit(features, positives, qc.PuParameters(positives=50, unlabelled=100, steps=50))
    assert model.prior == pytest.approx(0.37, abs=1e-6)


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    scores = qc.op6_pu_quality_classifier(spark, sf)
    rows = scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9

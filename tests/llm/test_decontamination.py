import hashlib

import pytest

from parcelloom.llm import decontamination as dc
from tests.llm import brute

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
BENCH = [(1, ITEM), (10, "Short item here"), (2, ITEM + " rho"), (3, None), (4, ""), (None, "null id item"), (5, "??"), (6, "the the the the the the the the the the the the the the")]
TEXTS = [
    ITEM, "Before it: " + ITEM.upper() + ", after. " + "word " * 400, "alpha beta gamma", "x short ITEM, here! y", None, "", "...", "the " * 40, "a null-id item b", "a null id item b",
    "mu nu xi omicron " + ITEM + " " + ITEM, " ".join(ITEM.split()[:12]), brute.LONG + " short item here",
]


def bench(spark, rows=None):
    return spark.createDataFrame(BENCH if rows is None else rows, "item_id long, text string")


def want(text, items, n=13):
    windows = {}
    for i, t in items:
        w = brute.alnum(t)
        if w:
            for j in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    w, hit, found = brute.alnum(text), set(), set()
    for m in {len(k) for k in windows}:
        for j in range(len(w) - m + 1):
            if (got := windows.get(tuple(w[j : j + m]))) is not None:
                hit |= set(range(j, j + m))
                found |= got
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def row(r):
    return r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]


def test_against_all_windows(spark):
    got = {r["doc_id"]: row(r) for r in dc.contamination(brute.documents(spark, TEXTS), bench(spark)).collect()}
    assert got == {i: want(t, BENCH) for i, t in enumerate(TEXTS)}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    got = {r["doc_id"]: row(r) for r in dc.contamination(brute.documents(spark, TEXTS), bench(spark)).collect()}
    assert got == {i: want(t, BENCH) for i, t in enumerate(TEXTS)}


def test_repeats_nulls_and_empty(spark):
    df = brute.documents(spark, [ITEM, ITEM, "clean text", ITEM], [1, 1, None, None])
    got = dc.contamination(df, bench(spark)).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in got) == [("1", True), ("1", True), ("None", False), ("None", True)]
    assert dc.contamination(brute.documents(spark, []), bench(spark)).count() == 0
    assert not any(r["n_hit"] for r in dc.contamination(df, bench(spark, [])).collect())


def test_removal_leaves_no_window_and_clean_rows_alone(spark):
    df = brute.documents(spark, TEXTS)
    out = dc.decontaminated(df, bench(spark))
    assert out.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in enumerate(TEXTS):
        _, hit, _, _, bad = want(t, BENCH)
        assert (i in left) != bad
        if i in left:
            assert left[i] == t if not hit else want(left[i], BENCH)[1] == 0
    assert left[1].startswith("Before it") and left[1].count("word") == 400


@pytest.mark.parametrize("most", [dc.BROADCAST_BYTES, -1])
def test_no_python_in_the_plan(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", most)
    plan = dc.contamination(brute.documents(spark, TEXTS[:4]), bench(spark))._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 0)
    for name in ("Python", "MapInArrow", "ArrowEval", "CartesianProduct", "NestedLoop"):
        assert name not in plan

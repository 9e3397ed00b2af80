import random

import numpy as np
import pytest

from parcelloom.llm import ngram_join as nj
from parcelloom.llm.components import connected, local_components
from tests.llm import brute


def result(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()}


def near_texts(seed, n=60):
    rng = random.Random(seed)
    base = [[f"{chr(97 + rng.randrange(26))}{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 12, 40, 150]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        if rng.random() < 0.2:
            w = w[: max(1, len(w) - rng.randrange(4))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_against_all_pairs(spark, k, num, den):
    texts = brute.TEXTS + near_texts(k)
    want = brute.jaccard(list(enumerate(texts)), k, num, den)
    assert result(nj.ngram_jaccard_join(brute.documents(spark, texts).repartition(5), k, num, den)) == {(i, *v) for i, v in want.items()}


def test_cut_blocks_give_the_same(spark, monkeypatch):
    texts = near_texts(3, 80)
    want = brute.jaccard(list(enumerate(texts)), 4, 85, 100)
    monkeypatch.setattr(nj, "BLOCK_ROWS", 3)
    assert result(nj.ngram_jaccard_join(brute.documents(spark, texts), 4, 85, 100)) == {(i, *v) for i, v in want.items()}


def test_a_passage_in_common_does_not_ship_rows_to_many_tasks(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    glued = [f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(120)]
    near = [f"{t} more" for t in glued[:10]] + [t.replace("p7", "q7") for t in glued[5:12]] + near_texts(6, 40)
    texts = glued + near
    seen, put = {}, nj.written
    monkeypatch.setattr(nj, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nj, "written", lambda df, name="table": seen.setdefault(name, put(df, name)))
    want = brute.jaccard(list(enumerate(texts)), 5, 80, 100)
    # repeated rows count once in the order of shingles
    assert result(nj.ngram_jaccard_join(brute.documents(spark, texts + texts[:3], [*range(len(texts)), 0, 1, 2]))) == {(i, *v) for i, v in want.items()}
    members = {r["doc_id"]: r["cut"] for name in ("members", "finer") if name in seen for r in seen[name].collect() if name == "finer" or "finer" not in seen or r["cut"] == 1}
    assert max(members.values()) <= 5 and sum(members.values()) < 2 * len(texts)


def test_texts_that_share_an_id_are_ranked_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = brute.documents(spark, [a, b, f"{a} end", f"{b} end"], [1, 1, 2, 3])
    rows = df.select("doc_id", "text").mapInArrow(nj._rows(5), "doc_id long, body binary")
    assert {(r["node"], r["root"]) for r in nj.rare_blocks(rows, 80, 100).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_nulls_repeats_and_empty(spark):
    df = brute.documents(spark, ["a b c d e", "a b c d e", "a b c d e", "q"], [5, 5, None, None])
    rows = sorted(result(nj.ngram_jaccard_join(df, 4, 85, 100)), key=str)
    assert rows == sorted({(5, 2, 5, 0), (None, 2, None, 0), (None, 1, None, 0)}, key=str)
    assert nj.ngram_jaccard_join(df, 4, 85, 100).count() == 4
    none = brute.documents(spark, [])
    assert nj.ngram_jaccard_join(none).count() == 0
    kept = nj.one_of_each(brute.documents(spark, ["a b c d e f", "a b c d e f", None, ""]))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 3} and kept.columns == none.columns


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
        drop = rng.random(len(a)) < rng.choice([0.02, 0.05, 0.08])
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 52, int(rng.integers(0, 1 + len(a) // 12))).astype(np.uint64)]))
        if not len(b):
            continue
        share = len(np.intersect1d(a, b))
        if share * 100 >= 85 * (len(a) + len(b) - share):
            t, k = nj.range_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), nj.SizeClasses(85, 100))
            assert set(k[t == 0].tolist()) & set(k[t == 1].tolist())


def test_tiles_give_all_links(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(20, 60)), replace=False), rng.integers(0, 1 << 40, 3).astype(np.uint64)])) for _ in range(30)]
    monkeypatch.setattr(nj, "TILE", 7)
    monkeypatch.setattr(nj, "COLUMNS", 11)
    got = {tuple(sorted(p)) for i, j in nj.links(sets, np.arange(30), None, 60, 100) for p in zip(i.tolist(), j.tolist())}
    apart = {tuple(sorted(p)) for i, j in nj.links(sets, np.arange(12), np.arange(12, 30), 60, 100) for p in zip(i.tolist(), j.tolist())}
    want = set()
    for i in range(30):
        for j in range(i + 1, 30):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n and n * 100 >= 60 * (len(sets[i]) + len(sets[j]) - n):
                want.add((i, j))
    assert got == want and apart == {(i, j) for i, j in want if i < 12 <= j}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = local_components(600, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: int(want[i]) for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_copies_speak_once():
    import numpy as np

    from parcelloom.llm import ngram_join as nj

    ids = np.array([5, 3, 9, 3, 7])
    prints = np.array([[1, 1], [1, 1], [2, 1], [1, 1], [2, 2]], dtype=np.uint64)
    assert nj._speakers(ids, prints).tolist() == [False, True, True, False, True]

"""Substring dedup and license scans."""

import hashlib
import random

import pytest

from parcelloom.llm import licenses as lic
from parcelloom.llm import substring_dedup as sd
from tests.llm import brute


def repeats(rows, window=13):
    first, words = {}, {}
    for n, (i, t) in enumerate(rows):
        w = words[n] = brute.spaced(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for n, (i, _) in enumerate(rows):
        w, gone = words[n], set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (float("inf") if i is None else i):
                gone |= set(range(j, j + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def passages(seed, n=50):
    rng = random.Random(seed)
    pool = [[f"p{i}w{j}" for j in range(rng.choice([6, 12, 13, 14, 20, 60]))] for i in range(8)] + [["the"] * 30]
    out = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += p[a:] if rng.random() < 0.3 else p
            w += [f"d{d}x{rng.randrange(50)}" for _ in range(rng.randint(0, 12))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 6)])
def test_against_all_windows(spark, seed, parts):
    texts = brute.TEXTS + passages(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    assert result(sd.remove_repeats(brute.documents(spark, texts, ids).repartition(parts))) == repeats(list(zip(ids, texts)))


def test_nulls_repeats_and_empty(spark):
    texts = [brute.TEXTS[0], brute.TEXTS[0], brute.TEXTS[0], "a b", None]
    ids = [4, 4, None, None, 1]
    assert result(sd.remove_repeats(brute.documents(spark, texts, ids))) == repeats(list(zip(ids, texts)))
    assert sd.remove_repeats(brute.documents(spark, [])).count() == 0
    kept = {r["doc_id"]: r["kept_text"] for r in sd.remove_repeats(brute.documents(spark, ["x " + brute.TEXTS[0], brute.TEXTS[0] + " y"])).collect()}
    assert kept[1] == "y" and kept[0].startswith("x The quick")


def test_windows_that_sums_of_powers_confuse(spark):
    one, two = brute.thue_morse(10)
    tail = " ".join(f"w{i}" for i in range(12))
    texts = [f"{one} {tail}", f"{two} {tail}", " ".join(brute.thue_morse(4)[0]), " ".join(brute.thue_morse(4)[1]), " ".join(brute.thue_morse(5)[0])]
    assert result(sd.remove_repeats(brute.documents(spark, texts))) == repeats(list(enumerate(texts)))


@pytest.mark.parametrize("spread", [1, 5000, 2**33, 2**56])
def test_entries_don_t_grow_with_the_parts(spark, tmp_path, monkeypatch, spread):
    texts = passages(5)
    ids = [(i - 20) * spread for i in range(len(texts))]
    df = brute.documents(spark, texts, ids).coalesce(1)
    want, sizes = repeats(list(zip(ids, texts))), []
    for parts in (1, 8, 64):
        monkeypatch.setattr(sd, "parts_for", lambda *a, n=parts: n)
        assert result(sd.remove_repeats(df)) == want
        (tmp_path / f"{parts}").mkdir()
        rows = df.select("doc_id", "text").mapInArrow(sd._scan(sd.Method(13, parts), str(tmp_path / f"{parts}")), sd._ROWS).where("part >= 0").collect()
        sizes.append(sum(len(r["docs"]) for r in rows))
    assert len(set(sizes)) == 1


def test_packing():
    import numpy as np

    for x in ([], [0], [0, 0, 5], [65534, 65535, 65536], [3, 200_000, 200_000, 10_000_000]):
        a = np.array(x, dtype=np.int64)
        assert sd._unpack(sd._pack(a)).tolist() == x


def base(text):
    w, at, labels = brute.alnum(text), [], set()
    for phrase, label in lic.PHRASES.items():
        q = phrase.split()
        for j in range(len(w) - len(q) + 1):
            if w[j : j + len(q)] == q:
                at.append(j)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


NOTICES = {t.label: t.text for t in lic.TEMPLATES}
LICENSED = [*brute.TEXTS, *("Some code. " * 3 + n.capitalize() + ". More." for n in NOTICES.values()), "mit license MIT-License", "cc by cc by", "gnu general public", "the license", NOTICES["mit-text"].replace("without restriction", "with restriction"), " ".join(sorted(NOTICES["bsd"].split())), "license " * 5000]


def test_phrases_and_templates(spark):
    rows = {r["doc_id"]: r for r in lic.license_scan(brute.documents(spark, LICENSED).repartition(3)).collect()}
    assert len(rows) == len(LICENSED)
    for i, t in enumerate(LICENSED):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    for n, label in enumerate(NOTICES):
        r = rows[len(brute.TEXTS) + n]
        assert label in r["labels"].split(",") and r["score"] == 1.0
    at = len(brute.TEXTS) + len(NOTICES)
    assert rows[at + 4]["labels"] == "" and rows[at + 5]["labels"] == "" and rows[at + 6]["score"] == 0.0


def test_a_few_changed_words_are_forgiven(spark):
    w = NOTICES["mit-text"].split()
    w[20] = w[30] = "changed"
    w.insert(len(w) // 2, "inserted")
    found = lic.license_scan(brute.documents(spark, ["x y " + " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :])])).first()
    assert found["labels"] == "mit-text" and 0.9 < found["score"] < 1


def test_notices_beside_other_notices(spark):
    together = [("apache-2.0", "mit-text"), ("gpl-3.0", "isc"), ("mit-notice", "bsd"), ("mit-notice", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"), tuple(NOTICES)]
    texts = [" and here some code ".join(NOTICES[n] for n in names) for names in together]
    rows = {r["doc_id"]: r for r in lic.license_scan(brute.documents(spark, [*texts, *["permission license software"] * 20])).collect()}
    for i, names in enumerate(together):
        assert set(names) <= set(rows[i]["labels"].split(",")) and rows[i]["score"] == 1.0, names


def test_all_words_of_a_template_are_looked_up():
    index = lic.Index(rarest=3)
    w = NOTICES["mit-text"].split()
    for k in (10, 16, 38, 44):  # outside of the mandatory phrases
        text = " ".join([*w[:k], "changed", *w[k + 1 :], "and", NOTICES["bsd"]])
        h = next(lic.tk.words(lic.pa.array([text]), lic.tk.ALNUM, lower=True))
        found = index.scan(h.hash, *index.known(h), lic.np.arange(len(index.labels)))
        assert found[index.labels.index("mit-text")] == (len(w) - 1) / len(w) and found[index.labels.index("bsd")] == 1.0


def test_as_many_words_may_be_missing_as_the_coverage_says(spark):
    w = NOTICES["isc"].split()
    isc = " ".join("changed" if i in (3, 8, 10, 18) else x for i, x in enumerate(w))  # words that stand there once
    w = NOTICES["gpl-2.0"].split()
    gpl = " ".join("changed" if i in (1, 2, 5, 6, 9, 11, 28) else x for i, x in enumerate(w))
    rows = {r["doc_id"]: r for r in lic.license_scan(brute.documents(spark, ["Licensed under the MIT License", isc, gpl])).collect()}
    assert [rows[i]["labels"] for i in range(3)] == ["mit,mit-notice", "isc", "gpl,gpl-2.0"]
    assert [rows[i]["score"] for i in range(3)] == [0.8, 0.8, 0.8]
    for n, need in zip(lic.Index().number, lic.Index().needs):
        assert need == len(set(n.tolist())) - len(n) * 20 // 100


def test_empty(spark):
    assert lic.license_scan(brute.documents(spark, [])).count() == 0

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelloom.llm import textkernel as tk
from tests.llm import brute

TEXT = st.text(alphabet=st.sampled_from(list("aAbZ09 \t\n\x0b\x0c\r\x00\x1f.,#é漢 ")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    for table, lower, find in ((tk.SPACED, False, brute.spaced), (tk.ALNUM, True, brute.alnum)):
        got = [[] for _ in texts]
        hashes = {}
        for w in tk.words(column, table, lower):
            for d, h, a, b in zip(w.doc, w.hash, w.start, w.end):
                word = w.data[a:b].tobytes().decode()
                got[w.lo + d].append(brute.lower(word) if lower else word)
                assert hashes.setdefault(got[w.lo + d][-1], h) == h
        assert got == [find(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)
    assert tk.word_counts(column).tolist() == [len(brute.spaced(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 4))
def test_sets_have_the_right_sizes_and_lines_repeat(texts, k):
    column = pa.array(texts, pa.string())
    want = brute.shingle_sets(list(enumerate(texts)), k)
    for w in tk.words(column, lower=True):
        assert np.diff(tk.shingle_sets(w, k)[1]).tolist() == [len(want[w.lo + i]) for i in range(w.texts)]


def test_pieces_don_t_change_anything(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 50, "é"]) for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["z" * 5000, None, ""]
    column = pa.array(texts, pa.string())
    whole = [(w.hash, w.doc + w.lo) for w in tk.words(column)]
    counts = tk.word_counts(column)
    monkeypatch.setattr(tk, "PIECE", 300)
    cut = [(w.hash, w.doc + w.lo) for w in tk.words(column)]
    for n in (0, 1):
        assert np.array_equal(np.concatenate([x[n] for x in whole]), np.concatenate([x[n] for x in cut]))
    assert np.array_equal(counts, tk.word_counts(column))


def test_slices_of_columns():
    column = pa.array(["skip me", "a b", None, "c"]).slice(1)
    assert tk.word_counts(column).tolist() == [2, 0, 1]
    assert [len(w.hash) for w in tk.words(column)] == [3]


@pytest.mark.parametrize("n", [0, 1, 3, 10])
def test_runs(n):
    h = tk.mix64(np.arange(10, dtype=np.uint64))
    assert len(tk.shingles(h[:n], 3)) == max(0, n - 2)
    assert tk.covered(6, np.array([1, 4]), 3).tolist() == [False, True, True, True, True, True]


@pytest.mark.parametrize("n", [5, 6, 10, 12])
def test_words_that_sums_of_powers_confuse(n):
    one, two = brute.thue_morse(n)
    w = next(tk.words(pa.array([f"{one} {two} {one}", " ".join(one), " ".join(two)])))
    assert w.hash[0] == w.hash[2] != w.hash[1]
    first = w.first()
    runs = [tk.shingles(w.hash[first[d] : first[d + 1]], 2**n)[0] for d in (1, 2)]
    assert runs[0] != runs[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=20), st.data())
def test_bytes_are_compared(spans, data):
    other = [data.draw(st.sampled_from([s, s[:-1] + b"!", s + b"x"])) for s in spans]
    one, two = (np.frombuffer(b"".join(x), np.uint8) for x in (spans, other))
    sizes, lengths = (np.array([len(s) for s in x]) for x in (spans, other))
    starts, begins = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
    assert tk.same_bytes(one, starts, starts + sizes, two, begins, lengths).tolist() == [a == b for a, b in zip(spans, other)]
    h, g = tk.span_hashes(one, starts, starts + sizes), tk.span_hashes(two, begins, begins + lengths)
    assert (h == g).tolist() == [a == b for a, b in zip(spans, other)]
    assert not (h == tk.span_hashes(one, starts, starts + sizes, 1)).any()

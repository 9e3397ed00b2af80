"""Plain Python versions of the operators' results, and small tables."""

import re
from collections import Counter, defaultdict

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))  # a long text: more than one piece
TEXTS = [
    "The quick brown fox jumps over the lazy dog while many small birds watch it from the old oak tree near the river bank today",
    "the quick brown fox jumps over the lazy dog while many small birds watch it from the old oak tree near the river bank today",
    "The quick brown fox jumps over the lazy dog while many small birds watch it from the old oak tree near the river bank tonight",
    None, "", " \n\t ", "one", "two words", "ONE", "a b c", "é ü ß é ü ß é ü ß", LONG, LONG + " tail", "x\x00y z\x1fq", "dup line\ndup line\n\nother\ndup line",
    "# * $ % & | < >", "released under the MIT License.", "licensed under the Apache License, Version 2.0.", "  lead and trail  ",
]


def thue_morse(n: int) -> tuple[str, str]:
    """The first ``2**n`` letters of the Thue-Morse word and of its complement, which sums of powers cannot tell apart."""
    swap, word = str.maketrans("ab", "ba"), "a"
    for _ in range(n):
        word += word.translate(swap)
    return word, word.translate(swap)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, shard int, _size string, component_id string"


def documents(spark, texts=None, ids=None):
    """A table of documents with columns whose names clash with operators' own."""
    texts = TEXTS if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "b", None, "c"][k % 4], len(t or ""), "p", 7, "s", "c") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, COLUMNS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = spaced(lower(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def jaccard(rows, k, num, den):
    """For each id the size of its set, the smallest id that links reach, and its number of links."""
    sets = shingle_sets(rows, k)
    of = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            of[g].append(i)
    both = Counter((a, b) for ids in of.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    up, degree = {i: i for i in sets}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if n * den >= num * (len(sets[a]) + len(sets[b]) - n):
            degree[a] += 1
            degree[b] += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), degree[i]) for i, s in sets.items()}


def base_counts(text):
    w = spaced(text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)

"""Sharding, mixing, token files and archives."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelloom.llm import mixing, rans, sharding, token_output, warc
from tests.llm import brute


def test_matrix_adds_up_and_is_unbiased():
    counts, sizes = [5, 0, 7, 30], sharding.shard_sizes(42, 4)
    assert sorted(sizes) == [10, 10, 11, 11]
    mean = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes
        mean += np.array(m) / 400
    want = np.outer(counts, sizes) / 42
    assert np.abs(mean - want).max() < 0.4
    big = sharding.communication_matrix([10**6, 10**6], sharding.shard_sizes(2 * 10**6, 24), 1)
    assert max(abs(x - 41667) for r in big for x in r) < 1500


def test_hypergeometric_law():
    rng = random.Random(0)
    got = Counter(sharding._hypergeometric(rng, 6, 4, 5) for _ in range(20000))
    from math import comb

    for k in range(1, 6):
        assert got[k] / 20000 == pytest.approx(comb(6, k) * comb(4, 5 - k) / comb(10, 5), abs=0.015)


def test_shards_are_exact(spark, tmp_path):
    df = brute.documents(spark, [f"t{i % 50}" for i in range(500)] + [None] * 3, [*range(250)] * 2 + [None] * 3)
    out = sharding.uniform_shards(df, 24, ["doc_id", "text"])
    rows = out.collect()
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 503 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s])) for s in sizes)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.uniform_shards(df.repartition(7), 24, ["doc_id", "text"]).collect()}
    assert sharding.uniform_shards(brute.documents(spark, []), 24, ["doc_id"]).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 5, ["doc_id", "text"])
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 5
    few = sharding.uniform_shards(brute.documents(spark, ["a", "b"]), 24, ["doc_id"]).collect()
    assert {r["shard"] for r in few} == {0, 1}


def test_shards_mix_neighbours(spark):
    rows = sharding.uniform_shards(spark.range(4800).withColumnRenamed("id", "doc_id"), 24, ["doc_id"]).collect()
    first = Counter(r["shard"] for r in rows if r["doc_id"] < 2400)
    assert all(60 < first[s] < 140 for s in range(24))
    place = np.corrcoef([r["doc_id"] for r in rows], [r["slot"] for r in rows])[0, 1]
    assert abs(place) < 0.06


def test_rows_that_agree_are_spread(spark):
    """Thirty thousand equal rows of 40,000, nulls among them, and long texts in a column that is no key."""
    df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") >= 30_000, F.col("id")).alias("doc_id"), F.when(F.col("id") % 9999 == 0, F.repeat(F.lit("x"), 200_000)).alias("text"), F.lit("s").alias("shard"))
    apart = sharding.told_apart(df, ["doc_id"])
    assert apart.groupBy("doc_id", "_copy").count().agg(F.max("count")).first()[0] == 1 and apart.where("doc_id is not null and _copy <> 0").count() == 0
    sizes = apart.groupBy(F.pmod(F.xxhash64("doc_id", "_copy"), F.lit(24)).alias("p")).count().collect()
    assert len(sizes) == 24 and max(r["count"] for r in sizes) < 2 * 40_000 / 24
    rows = sharding.uniform_shards(df, 24, ["doc_id"]).select("doc_id", "shard", "slot", F.length("text").alias("n")).collect()
    assert len(rows) == 40_000 and sum(r["n"] is not None for r in rows) == 5
    assert {tuple(r) for r in df.where("doc_id is not null").select("doc_id").collect()} == {(r["doc_id"],) for r in rows if r["doc_id"] is not None}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == 40_000 and all(r["slot"] < counts[r["shard"]] for r in rows)


def test_targets():
    assert mixing.cyclic_weights([None, "b", "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}
    t = mixing.targets({"a": 10, "b": 10, "c": 980}, {"a": 1, "b": 2, "c": 3})
    assert t == {"a": 30, "b": 30, "c": 940}
    assert mixing.targets({"a": 0, "b": 5}, {"a": 1, "b": 1}) == {"a": 0, "b": 5}
    assert mixing.targets({}, {}) == {}


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(600)] + [None, "", "  "]
    df = brute.documents(spark, texts)
    out = mixing.mix(df)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(603))
    for source in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["_copies"] * r["_size"] for r in own) - own[0]["_target"]) <= 61
        assert all(0 <= r["_copies"] <= 3 for r in own)
        rate = own[0]["_target"] / own[0]["_source_size"]
        assert all(int(rate) <= r["_copies"] <= int(rate) + 1 for r in own)
    again = mixing.mix(df.repartition(6)).collect()
    assert sorted((r["doc_id"], r["_copies"]) for r in rows) == sorted((r["doc_id"], r["_copies"]) for r in again)
    repeated = mixing.mixed_rows(df)
    assert repeated.columns == df.columns
    assert Counter(r["doc_id"] for r in repeated.collect()) == Counter({r["doc_id"]: r["_copies"] for r in rows if r["_copies"]})


def test_equal_rows_are_mixed_together(spark):
    rows = [(1, "a b c", "x", 5)] * 300 + [(None, "d e", "x", 6)] * 100 + [(None, None, None, None)] * 50 + [(i, "w " * (i % 9), "y", i) for i in range(200)] + [(7, "same", "y", 1), (7, "same", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int").repartition(5)
    taken = mixing.mix(df).collect()
    assert len(taken) == len(rows) and Counter(r["doc_id"] for r in taken) == Counter(r[0] for r in rows)
    for source in ("x", "y"):
        own = [r for r in taken if r["source"] == source]
        assert abs(sum(r["_copies"] * r["_size"] for r in own) - own[0]["_target"]) <= 9
        assert max(r["_copies"] for r in own) - min(r["_copies"] for r in own) <= 1
    got = mixing.mixed_rows(df).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter({k: n for k in {(r["doc_id"], r["source"]) for r in taken} if (n := sum(r["_copies"] for r in taken if (r["doc_id"], r["source"]) == k))})
    assert {tuple(r) for r in got} <= set(rows)


def test_a_hundred_thousand_equal_rows(spark):
    df = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    assert mixing.mixed_rows(df).count() == 100_000


def test_mix_of_little(spark):
    assert mixing.mix(brute.documents(spark, [])).count() == 0
    one = mixing.mix(brute.documents(spark, ["a b c"])).first()
    assert one["_copies"] == 1 and one["_target"] == 3.0
    empty = mixing.mix(brute.documents(spark, [None, ""])).collect()
    assert len(empty) == 2 and {r["_size"] for r in empty} == {0}


def test_rounding_is_unbiased():
    import pyarrow as pa

    names = ["_src", "_bucket", "_key", "_size", "_mass", "_copies"]
    sizes = [3, 9, 4, 4, 7, 1, 12, 5]
    taken = np.zeros(8)
    for seed in range(600):
        b = pa.RecordBatch.from_pydict({"_src": [0] * 8, "_bucket": [0] * 8, "_key": [str(i) for i in range(8)], "_size": sizes, "_mass": [s * mixing.ONE // 4 for s in sizes], "_copies": [0] * 8})
        parts = [b.slice(0, 3), b.slice(3, 1), b.slice(4)]
        out = pa.Table.from_batches(list(mixing._pivot(seed, names)(iter(parts)))).to_pylist()
        open_ = [r for r in out if r["_mass"] is not None]
        assert len(out) == 8 and len(open_) <= 1
        assert sum(r["_size"] * r["_copies"] * mixing.ONE for r in out) + sum(r["_mass"] for r in open_) == sum(s * mixing.ONE // 4 for s in sizes)
        for r in out:
            taken[int(r["_key"])] += r["_copies"] + (r["_mass"] / r["_size"] / mixing.ONE if r["_mass"] else 0)
    assert np.abs(taken / 600 - 0.25).max() < 0.06


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 65535, 65536, 65537, 200_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    t = (rng.zipf(1.4, n) % 49000).astype(np.uint32) if n != 65 else np.zeros(n, np.uint32)
    raw = rans.encode(t, np.array([7]), np.array([n]))
    s = rans.Segment(raw)
    assert np.array_equal(s.decode(), t) and s.doc_ids.tolist() == [7]
    if n > 150_000:
        size = s.header["steps"] * s.header["lanes"]
        assert np.array_equal(s.decode(range(1, 3)), t[size : 3 * size])
        assert len(raw) < 2 * n
        for at in (len(raw) - 5, 400):
            bad = bytearray(raw)
            bad[at] ^= 1
            with pytest.raises((rans.CorruptSegment, ValueError)):
                rans.Segment(bytes(bad)).decode()


def test_all_symbols_once():
    t = np.random.default_rng(0).permutation(49408).astype(np.uint32)
    assert np.array_equal(rans.Segment(rans.encode(t, np.arange(1), np.array([len(t)]))).decode(), t)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    texts = [*brute.TEXTS, "don't <|endoftext|> stop", "mark \x01 in\x01side", "Ünï çödé ﬁ 漢字 ١٢٣", "é a b"]
    df = brute.documents(spark, texts, [*range(len(texts) - 1), None]).repartition(4)
    folder = str(tmp_path / "tokens")
    manifest = token_output.write_tokens(df, folder, tokenizer, 2)
    t = Tokenizer.from_file(tokenizer)
    order = [texts[-1], *texts[:-1]]
    want, start = [], 0
    for i, x in zip([None, *range(len(texts) - 1)], order):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_output.token_digests(manifest, folder).orderBy("start").collect()]
    assert got == want
    ids = {r["doc_id"]: r["ids"] for r in token_output.read_tokens(manifest, folder).collect()}
    assert ids[0] == [*t.encode(texts[0], add_special_tokens=False).ids, 2]
    assert token_output.written_and_read(brute.documents(spark, []), tokenizer).count() == 0
    twice = token_output.written_and_read(brute.documents(spark, ["a", "b", "a"], [1, 1, 1]), tokenizer).orderBy("start").collect()
    assert [r["doc_id"] for r in twice] == [1, 1, 1] and [r["start"] for r in twice] == [0, 2, 4]


def test_a_tokenizer_that_keeps_white_space(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = token_output.TextEncoder(path), Tokenizer.from_file(path)
    assert not e.by_word
    ids, n = e.encode(pa.array(["a  b", None, " c"]))
    assert n.tolist() == [len(t.encode(x).ids) for x in ("a  b", "", " c")]


def test_words_with_one_fingerprint(tokenizer, monkeypatch):
    import pyarrow as pa

    plain = token_output.tk.span_hashes
    monkeypatch.setattr(token_output.tk, "span_hashes", lambda *a: plain(*a) % np.uint64(3))
    e = token_output.TextEncoder(tokenizer)
    for text in ("a b c d", "e f g h", "a b x y z w v u", "a"):
        ids, n = e.encode(pa.array([text, None, text]))
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def test_forgetting_words(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_output, "REMEMBERED", 5)
    e = token_output.TextEncoder(tokenizer)
    for text in ("a b c d", "e f g h", "a b x y z w v u", "a"):
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


PAGES = "page_id long, url string, html string, extra string"


def pages(spark):
    big = "".join(chr(97 + i % 26) for i in range(3_000_000))
    rows = [(5, "http://a/x y", "same", "e"), (3, "http://b\r\nX: y", "same", "e"), (9, None, "same", "e"), (1, "http://c", None, "e"), (2, "http://d", "", "e"), (7, "http://e", "ünï\r\n\r\ncode", "e"), (8, "http://f", big, "e"), (10, "http://g", big, "e"), (None, "http://h", "null id", "e")]
    return spark.createDataFrame(rows, PAGES)


def test_archives(spark, tmp_path):
    df = pages(spark)
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(df.repartition(3), folder)
    rows = {r["page_id"]: r for r in warc.read_chunks(manifest, folder, with_data=False).where("last").collect()}
    import base64

    for r in df.collect():
        raw = (r["html"] or "").encode()
        got = rows[r["page_id"]]
        assert got["payload_bytes"] == len(raw) and got["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: r["refers_to"] for i, r in rows.items()} == {5: 3, 3: None, 9: 3, 1: None, 2: 1, 7: None, 8: None, 10: 8, None: None}
    assert {r["record_type"] for i, r in rows.items() if i in (5, 9, 2, 10)} == {"revisit"}


def test_chunks_carry_digests(spark, tmp_path):
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(pages(spark), folder)
    rows = warc.read_chunks(manifest, folder, chunk=1 << 18).where("page_id = 8").orderBy("chunk").collect()
    sha, size = hashlib.sha1(), 0
    import base64

    assert len(rows) == -(-3_000_000 // (1 << 18)) and [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]
    for r in rows:
        sha.update(r["data"])
        size += len(r["data"])
        assert r["payload_digest"] == base64.b32encode(sha.digest()).decode() and r["payload_bytes"] == size and len(r["data"]) <= 1 << 18


def test_small_payloads_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(pages(spark), folder, min_bytes=1000)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_chunks(manifest, folder).where("last").collect()}
    assert kinds[5] == kinds[9] == kinds[2] == "response" and kinds[10] == "revisit"
    none = spark.createDataFrame([], PAGES)
    m = warc.write_archives(none, str(tmp_path / "none"))
    assert m.count() == 0 and warc.read_chunks(m, str(tmp_path / "none")).count() == 0


def test_repeated_pages_and_clashing_columns(spark, tmp_path):
    """A repeated page is written as often as it comes; page_id 4 has two payloads."""
    rows = [(4, "u", "one"), (4, "u", "one"), (4, "u", "two"), (6, "u", "one"), (6, "u", "one"), (None, "u", "one"), (None, "u", "nul"), (None, "u", "nul")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n, name in enumerate(("_key", "_first", "_page", "_digest", "_revisit", "chunk", "last", "data")):
        df = df.withColumn(name, F.lit(n))
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(df, folder)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_chunks(manifest, folder).where("last").collect()), key=str)
    assert got == sorted([(4, "response", None)] * 3 + [(6, "revisit", 4)] * 2 + [(None, "revisit", 4)] + [(None, "response", None)] * 2, key=str)


def test_a_changed_payload_is_found(spark, tmp_path):
    folder = tmp_path / "warc"
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "hello world", "")], PAGES), str(folder))
    (file,) = folder.glob("*.warc.gz")
    raw = zlib.decompress(file.read_bytes(), 31).replace(b"hello", b"jello")
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    file.write_bytes(c.compress(raw) + c.flush())
    with pytest.raises(Exception, match="digest"):
        warc.read_chunks(manifest, str(folder)).collect()


def test_archives_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    ours = {tuple(r) for r in warc.op8_chunked_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert ours == set(duckdb.sql(warc.OP8_SQL).fetchall())


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(i, "w " * (i % 37 if i % 11 else 600), None if i % 13 == 0 else f"s{min(i % 23, i % 7)}" if i % 5 else f"é{i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    few = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    assert sorted(map(str, mixing.mix(df).collect())) == few
    with pytest.raises(ValueError):
        mixing.mix(df, lambda names: dict.fromkeys(names, 1))


def test_repeated_words_are_looked_up_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, t, asked, search = token_output.TextEncoder(path), Tokenizer.from_file(path), [], np.searchsorted
    texts = ["some words again " * 500, None, "again others"]

    def counted(a, v, *more):
        asked.extend([np.size(v)] if a is e.known else [])
        return search(a, v, *more)

    monkeypatch.setattr(np, "searchsorted", counted)
    ids, n = e.encode(pa.array(texts))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    assert asked and max(asked) <= 4

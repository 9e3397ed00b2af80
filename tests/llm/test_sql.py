"""The queries that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from parcelloom.llm.licenses import TEMPLATES
from parcelloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    compare(spark, name, SF, ("documents", "benchmark", "pages"))


def compare(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        file = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{file}{'/*.parquet' if os.path.isdir(file) else ''}'")
    theirs, ours = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, folder)
    order = sorted(theirs.columns)
    assert sorted(ours.columns) == order
    at = [theirs.columns.index(c) for c in order]
    rows = [tuple(r[c] for c in order) for r in ours.collect()]
    assert sorted(rows, key=str) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=str)
    return [dict(zip(order, r)) for r in rows]


def odd(spark, folder):
    """Nulls, empty and long texts, repeated rows, junk, and every pair of notices, whole or with a word changed."""
    notices = [t.text for t in TEMPLATES]
    pairs = [f"intro {a} between {b.replace(' ', ', ')} end" for a in notices for b in notices]
    changed = [" ".join(w if k != n else "other" for k, w in enumerate(t.split())) for t in notices for n in range(len(t.split()))]
    prose = [f"the cat and the dog {i} went to the park and they saw the sun " + " ".join(f"the n{i}o{j} and" for j in range(60)) for i in range(60)]
    texts = brute.TEXTS + pairs + changed + prose + prose[:3] + ["$%# " * 400, "zq " * 300, " ".join(f"#{i}%$*" for i in range(300))]
    df = brute.documents(spark, texts, [None if k % 50 == 7 else k for k in range(len(texts))])
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return len(texts)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op10_license_scan"])
def test_odd_rows_are_those_of_the_sql(spark, name, tmp_path):
    n = odd(spark, tmp_path)
    rows = compare(spark, name, str(tmp_path), ("documents",))
    assert len(rows) == n
    if name == "op2_quality_rules":
        assert any(not r["base_failed"] and not r["kept"] for r in rows) and any(r["kept"] for r in rows)
    else:
        assert {x for r in rows for x in r["labels"].split(",")} >= {t.label for t in TEMPLATES} and any(0 < r["score"] < 1 for r in rows)


def test_every_query_has_the_columns_of_its_contract(spark):
    want = {
        "op1": "doc_id n_shingles component_id", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4": "doc_id size text_crc32 law shard slot grown_shard", "op5": "doc_id start n_tokens ids_crc32", "op6": "doc_id held_out score predicted", "op7": "doc_id n_words n_removed kept_sha256",
        "op8": "page_id payload_bytes payload_digest record_type refers_to", "op9": "doc_id size source_size target taken", "op10": "doc_id n_words n_base first_word last_word base_labels labels score",
    }
    for name, run in QUERIES.items():
        columns = want[name.split("_")[0]].split()
        df = run(spark, SF)
        assert df.columns[: len(columns)] == columns, name
        rows = df.collect()
        table = "pages" if name.startswith("op8") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count(), name

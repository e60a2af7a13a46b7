"""Every registered query of the subpackage and the pipeline, run over the smallest tables; those with SQL against DuckDB."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries

DIR = "/root/testdata/sf0.001"
#: The columns that the contracts ask for.
COLUMNS = {
    "op1_token_store": "doc_id start n_tokens ids_crc32",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_shard_store": "doc_id",
    "op4_rank_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op7_quality_model": "doc_id held_out score predicted",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_dominance": "sale_id slot level n_sales n_rows",
}
#: Table and id of the queries that are not about documents.
TABLES = {"op11_warc": ("pages", "page_id"), "op12_hard_negatives": ("embeddings where vec_id % 100 = 0", "vec_id as anchor_id"), "op13_dominance": ("sales", "sale_id")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def plain(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = [tuple(r[c] for c in sorted(found.columns)) for r in found.collect()]
    table, key = TABLES.get(name, ("documents", "doc_id"))
    ids = sorted(x for (x,) in duck.execute(f"select {key} from {table}").fetchall())
    at = sorted(found.columns).index(key.split()[-1])
    assert sorted(r[at] for r in rows) == ids or name in ("op9_packing", "op12_hard_negatives") and {r[at] for r in rows} == set(ids)
    if name in queries.ORACLE_SQL:
        answer = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in answer.description]
        assert sorted(names) == sorted(found.columns)
        order = [names.index(c) for c in sorted(names)]
        assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "pii", "packing"]
    assert corpus_pipeline.run(spark, DIR).count() > 0

"""The registered queries: names and types of their contracts, and the SQL of those that it can express."""

import os

import duckdb
import pytest

from mailsonde.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op5_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_substring_dedup": "doc_id bigint, n_removed bigint, repeated boolean",
    "op7_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_phrase_mining": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("name", TYPES)
def test_contract(spark, name):
    out = queries.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    for column in TYPES[name].split(", "):
        k, kind = column.split(" ")
        assert kinds[k] == kind, column
    got = out.collect()
    if name == "op12_phrase_mining":
        assert got
    source = "embeddings" if "vec_id" in kinds else "pages" if "page_id" in kinds else "documents"
    assert name == "op12_phrase_mining" or len(got) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in queries.oracle_sql():
        db = duckdb.connect()
        for t in os.listdir(SF):
            db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
        columns = sorted(out.columns)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        row = lambda r: str([round(x, 9) if isinstance(x, float) else x for x in r])
        assert sorted(map(row, want)) == sorted(row([r[c] for c in columns]) for r in got)

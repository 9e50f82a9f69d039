import duckdb
import pytest

from tilesieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_license_index": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_simhash_pivots": "doc_id fingerprint component_id",
    "op7_quality_qda": "doc_id held_out score predicted",
    "op9_media_chunks": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op10_source_mixing": "doc_id size source_size target taken",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_has_a_result(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert df.select(key).distinct().count() == rows.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, con.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()))

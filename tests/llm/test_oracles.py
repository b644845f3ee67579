"""Queries with SQL match DuckDB; all return their contract's columns."""

import pytest

from spanrisk.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.harness import compare

COLUMNS = {
    "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_html_extract": "page_id url text n_chars",
    "op3_rule_forest": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_shard": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_mix": "doc_id size source_size target taken",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op13_resample": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck_small, name):
    ok, msg = compare(spark, duck_small, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    if name == "op11_prefix_trie":
        return  # a row per node
    table = {"op2_html_extract": "pages", "op12_warc": "pages", "op6_chat_format": "conversations"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert df.count() == want

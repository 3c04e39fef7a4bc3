"""The registered queries: consistent names, and a selection compared with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SELECTION = [
    "ds1_numeric_comparison", "ds4_shift_table", "txt1_text_metrics", "txt14_option_similarity", "ag2_category_by_split",
    "vt1_vote_features", "mo7_uncertainty", "mo13_gated_blend", "mo21_disagreements", "mo24_difficulty_tier", "jn3_hamming_pairs",
    "sp1_duplicate_components", "sp2_stratified_group_split", "cu3_apply_edits", "cu9_free_form_to_choices", "oc1_reading_order",
    "im1_size_metrics", "em4_centroid_distance",
]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_names_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 220


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SELECTION)
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())

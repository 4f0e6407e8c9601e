import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
QUICK = ["first_event_panel", "city_return_rates_a11", "listing_context_w1_w2_x6", "window_pairs_j5", "hash_sample_x1",
         "scored_text_t12", "screening_funnel_t13", "analysis_table_j6", "coerced_fields_s3", "descriptives_a7",
         "price_ranking_e1", "threshold_search_e4", "coder_reliability_e10", "clustered_ols_m2_m4", "partialled_effect_c3_c4",
         "one_split_tree_l6_l7", "forest_of_one_leaf_c6"]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("TIDEMARK_ALL_QUERIES") else QUICK
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, str(DATA))
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0

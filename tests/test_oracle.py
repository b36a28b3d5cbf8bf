"""A few registered queries against their SQL on the smallest tables; check_oracle.py runs them all."""

import duckdb
import pytest

from check_oracle import TABLES, compare
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = ("normalize_text", "compare_tokens", "suffix_link", "match_product_token_contain", "match_cjk_fuzzy", "case_coverage", "display_groups")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SF).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())

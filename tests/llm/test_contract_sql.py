import zlib

import duckdb
import pytest

from mnemora.llm import queries
from mnemora.llm.contract_sql import crc32

SF = "/root/testdata/sf0.01"


def test_crc32_in_sql():
    for digits in ("0", "7", "-45", "123456789"):
        assert duckdb.sql(f"SELECT {crc32('d')} FROM (SELECT '{digits}' AS d)").fetchall() == [(zlib.crc32(digits.encode()),)]


@pytest.mark.parametrize("name, view", [("op11_prefix_trie", "conversations"), ("op13_merkle_manifest", "documents")])
def test_query_against_sql(spark, name, view):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))

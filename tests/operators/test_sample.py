from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("keys", [range(0, 5999), range(0, 16001), range(0, 123457, 7), range(-4000, 31999, 3), []])
def test_blocks_are_those_of_the_sql_where_keys_end_within_a_block(spark, tmp_path, keys):
    rows = [(k,) for k in keys]
    spark.createDataFrame(rows, "l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.sql(entry.oracle_sql()["block_sample"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["block_sample"](spark, str(tmp_path)).collect()) == want

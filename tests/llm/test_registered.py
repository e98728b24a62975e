import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()))


def test_result_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op1": ["doc_id:bigint", "n_assign:bigint", "n_access:bigint", "n_hex:bigint", "base_sha256:string", "spans:string"],
        "op3": ["doc_id:bigint", "start:bigint", "length:bigint", "ids_crc32:bigint", "doc_tokens:bigint", "sequence_id:bigint", "offset:bigint"],
        "op4": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
        "op9": ["page_id:bigint", "host:string", "path:string", "rule:string", "verdict:string"],
    }
    found = {n.split("_")[0]: f for n, f in queries.queries().items()}
    for name, columns in want.items():
        assert [f"{c}:{t}" for c, t in found[name](spark, sf).dtypes] == columns
    assert queries.op2_toxicity(spark, "/root/testdata/sf0.01").where(F.col("toxic")).count() > 0

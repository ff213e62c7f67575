"""Queries against their SQL on the smallest tables; disclosing terms against SQL on a corpus that has some."""
import duckdb
import pytest

from tessera.llm import oracles
from tessera.llm.queries import ORACLE, QUERIES
from tessera.plans.oracle import compare, duck_connection, type_mismatches


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_small, name):
    got, con = QUERIES[name](spark, sf_small), duck_connection(sf_small)
    same, said = compare(got, con, ORACLE[name])
    assert same, said
    assert type_mismatches(got, con, ORACLE[name]) == []


def test_disclosing_terms(spark, tmp_path):
    rows = [(i, f"reach Ansprechmail user{i}@mail.example here\nplain line of words {i}") for i in range(30)]
    rows += [(100 + i, f"nothing here to see\nwords words line plain {i}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op5_private"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[-1] for r in con.sql(oracles.private_data(5, 0.9, 0.6)).fetchall()}
    assert got == want and "remove_email" in got[3]

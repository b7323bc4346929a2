"""The subpackage's queries, as registered, on sf0.001: against their SQL, or a row a document at least."""
import duckdb
import pytest

import __spark_entry__ as E
from tillpoint.llm.catalog import registry

SF = "/root/testdata/sf0.001"
#: Queries with one row a row of a table.
A_ROW_EACH = {"op1_token_files": "documents", "op2_token_counts": "documents", "op3_language_id": "documents", "op4_quality_classifier": "documents",
              "op5_jaccard_join": "documents", "op6_url_filter": "pages", "op8_source_mixing": "documents", "op9_quality_rules": "documents",
              "op10_fingerprints": "documents", "op11_vector_links": "embeddings"}


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, name):
    got = E.queries()[name](spark, SF).toPandas()
    if name in A_ROW_EACH:
        assert len(got) == spark.read.parquet(f"{SF}/{A_ROW_EACH[name]}.parquet").count()
    sql = E.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))
    assert len(got)

import pytest

from docloom.llm import queries
from tests.llm import fixtures
from tests.oracle import TABLES, assert_same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, small, name):
    assert_same(queries.queries()[name](spark, small), SQL[name], {t: f"{small}/{t}.parquet" for t in TABLES})


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op10_jaccard"}))
def test_edge_cases_equal_oracle(spark, tmp_path, name):
    path = fixtures.write(spark, tmp_path)
    assert_same(queries.queries()[name](spark, path), SQL[name], fixtures.views(path))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    path = fixtures.write(spark, tmp_path, documents=[], benchmark=[], pages=[], embeddings=[])
    assert queries.queries()[name](spark, path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_edge_cases_run_twice_alike(spark, tmp_path, name):
    path = fixtures.write(spark, tmp_path)
    drop = ("shard", "shard_bytes", "run")  # file names are new each time
    found = [sorted(repr(r) for r in (lambda df: df.select([c for c in df.columns if c not in drop]))(queries.queries()[name](spark, path)).collect()) for _ in range(2)]
    assert found[0] == found[1] and found[0]

"""Every registered query of the engine against DuckDB on the small tables."""

import pytest

from lithograin import queries
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, data_dir, name):
    assert_same(queries.QUERIES[name](spark, data_dir), con, queries.SQL[name])


def test_get_by_ids_looks_in_the_whole_table(spark, tmp_path, monkeypatch):
    spark.range(1, 41).selectExpr("id AS s_suppkey", "'name ' || id AS s_name", "3 AS s_nationkey", "1.5D AS s_acctbal").write.parquet(f"file://{tmp_path}/supplier.parquet")
    sizes = []
    look_up = queries.Database.get_by_ids

    def counted(db, name, *args, **options):
        sizes.append(db.count(name))
        return look_up(db, name, *args, **options)

    monkeypatch.setattr(queries.Database, "get_by_ids", counted)
    found = queries.get_by_ids(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, found)) == [(3, "name 3"), (5, "name 5")] and sizes == [40]

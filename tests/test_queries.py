"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    for found, verdict, _, count in compare(spark, FOLDER, [name]):
        assert verdict in ("ok", "rows only"), f"{found}: {verdict}"
        assert found not in ("c2_build_stays", "j6_code_pairs") or count > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    table = entry(spark)
    assert table.columns[0] == "pat_key" and table.count() > 0

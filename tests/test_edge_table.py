import random
import uuid

import pytest

from conftest import rows
from stayframe.operators.cooccurrence import merge_edges
from stayframe.operators.edge_table import EdgeTable

EDGE = "id1 bigint, id2 bigint, weight bigint"


def quarters(spark):
    rng = random.Random(3)
    return [
        spark.createDataFrame([(a, rng.randint(a + 1, 60), rng.randint(1, 9)) for a in rng.choices(range(50), k=200)], EDGE)
        for _ in range(4)
    ]


def test_quarter_by_quarter_equals_all_at_once(spark):
    table, parts = EdgeTable(spark, f"edges_{uuid.uuid4().hex}", buckets=4), quarters(spark)
    assert table.edges().collect() == []
    for n, part in enumerate(parts, 1):
        got = table.merge(part)
        assert rows(got) == rows(merge_edges(*parts[:n]))
        assert len(table.versions()) == n
    assert rows(table.edges(0)) == rows(merge_edges(parts[0]))  # older versions stay
    again = EdgeTable(spark, table.name, buckets=4)
    assert rows(again.merge(parts[0].limit(0))) == rows(merge_edges(*parts))


def test_old_edges_are_not_shuffled(spark):
    table, parts = EdgeTable(spark, f"edges_{uuid.uuid4().hex}", buckets=4), quarters(spark)
    table.merge(parts[0])
    plan = table.merged(parts[1])._jdf.queryExecution().executedPlan().toString()
    old = plan[plan.index("FullOuter") :]
    scan = next(i for i, line in enumerate(old.splitlines()) if "FileScan" in line or "Scan parquet" in line)
    above = old.splitlines()[:scan]
    assert "SortMergeJoin" in plan and not any("Exchange" in line for line in above), plan


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        EdgeTable(spark, "a; drop table b")

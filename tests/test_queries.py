"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from repograph.queries import code, graphs, relations, scalars  # noqa: F401
from repograph.queries.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = got.collect()
    assert found, "no rows"
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(got.columns) == sorted(columns)
        want = rows(columns, cursor.fetchall())
        mine = rows(got.columns, [tuple(r) for r in found])
        assert len(mine) == len(want)
        bad = [(a, b) for a, b in zip(mine, want) if a != b]
        assert not bad, bad[:3]

"""Every registered query with an oracle against DuckDB on the same tables."""

import os

import pytest

from rosterforge.plans import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows):
    plain = [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    if "greedy" in name:
        sizes = {r.cluster_id: r.cluster_size for r in rows}
        assert all(sum(r.cluster_id == c for r in rows) == n for c, n in sizes.items())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

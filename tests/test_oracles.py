"""Every registered query against its SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
ALL = entry_module.queries()
# Queries over training text are tested in their own folder.
QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(ALL) and set(ORACLES) <= set(entry_module.oracle_sql()) <= set(ALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = tables.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    expected = tables.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]}) AS q").fetchall()
    assert expected, "an empty result checks nothing"
    assert _sorted(frame.select(*columns).collect()) == _sorted(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 34


def test_timeline_order(spark):
    rows = QUERIES["funnel_timeline"](spark, SF).collect()
    assert rows == sorted(rows, key=lambda r: (r.timestamp_ms, r.batch_id, r.event_index))

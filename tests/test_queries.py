"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["packet_idx", "track", "name", "depth", "end_idx", "dur_ns", "parent_idx"]


def test_durations_beyond_bigint(spark, tmp_path):
    """A sum that is no bigint is an exact decimal; up to there the column is a bigint, as in SQL."""
    span = 10_000_000  # seconds
    for tracks in (1000, 900):
        at = [(2 * i + e, ("2024-01-01", "2024-04-25 17:46:40")[e], i, ("view", "error")[e], 0.0, "{}") for i in range(tracks) for e in range(2)]
        e = spark.createDataFrame(at, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        e.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / str(tracks) / "events.parquet"))
        df = catalog.QUERIES["slice_durations"](spark, str(tmp_path / str(tracks)))
        assert [tuple(r) for r in df.collect()] == [("view", 1, tracks, tracks * span * 10**9, span * 10**9)]
        assert df.schema["total_ns"].dataType.simpleString() == ("decimal(38,0)" if tracks == 1000 else "bigint")

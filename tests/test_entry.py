import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sigloom.plans import queries as engine


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("sigloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sigloom.llm", None)
    assert set(entry.queries()) == set(engine.QUERIES) and set(entry.oracle_sql()) == set(engine.SQL)


@pytest.mark.parametrize("name", ["rms_crest", "clipping_runs", "stationarity", "interpolate_missing", "spectral_descriptors", "local_outlier_factor", "robust_z"])
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    frame = engine.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    ours = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    theirs = con.execute(f"select {', '.join(columns)} from ({engine.SQL[name]})").fetchall()
    assert ours == sorted(theirs)


def test_daily_windows_of_zeros_match_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(
        f"""copy (select TIMESTAMP '2024-01-01 10:00:00' + to_hours(i::int) as ts, u as user_id, case when u = 2 then 1.5 when u = 3 and i = 0 then 'nan'::double
        when u = 4 and i = 0 then 'inf'::double when u < 5 then 0.0 end as value from range(20) a(i), range(1, 6) b(u)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    frame = engine.QUERIES["daily_window_stats"](spark, str(tmp_path))
    ours = sorted(map(str, map(tuple, frame.collect())))
    assert ours == sorted(map(str, con.execute(f"select {', '.join(frame.columns)} from ({engine.SQL['daily_window_stats']})").fetchall()))
    assert sum("nan" in r for r in ours) >= 2

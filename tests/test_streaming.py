"""The streaming jobs: over several runs, with rows that arrive late, and against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest

from folioscope.plans import streams
from folioscope.streaming import jobs

SF = "/root/testdata/sf0.001"
EVENT = "file_id long, at long, event_type string, fraction double"


def put(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def test_progress_never_goes_back(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [(1, 1, "view", 0.2), (1, 2, "view", 0.9), (2, 1, "view", 0.1), (None, 1, None, None)])
    schema = spark.read.parquet(src).schema
    for more in ([], [(1, 3, "view", 0.3), (2, 0, "view", 0.0)]):
        if more:
            put(spark, src, more)
        states = jobs.progress(jobs.arriving(spark, src, schema, files_at_once=1))
        jobs.drain_states(states, out)
        got = {r.file_id: (r.shown, r.reported, r.events) for r in jobs.latest(spark, out, "file_id", states.schema).collect()}
    assert got == {1: (0.9, 0.3, 3), 2: (0.1, 0.1, 2), None: (None, None, 1)}


def test_lifecycle(spark):
    rows = [(1, 1, "view", 0.1), (1, 2, "purchase", 1.0), (2, 1, "view", 0.1), (3, 1, "error", 0.0), (4, 1, "error", 0.0), (4, 2, "view", 0.5), (5, 1, "error", 0.0), (5, 2, "purchase", 1.0)]
    got = {r.file_id: r.state for r in jobs.lifecycle(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {1: "finished", 2: "open", 3: "failed", 4: "broken", 5: "broken"}
    assert jobs.lifecycle(spark.createDataFrame([], EVENT)).count() == 0


def test_adoption_takes_each_staged_file_once(spark, tmp_path):
    src, out = str(tmp_path / "staged"), str(tmp_path / "out")
    put(spark, src, [(1, 1, "a", 0.0)])
    schema = spark.read.parquet(src).schema
    assert jobs.adopt_staged(spark, src, schema, out).count() == 1
    assert jobs.adopt_staged(spark, src, schema, out).count() == 1
    put(spark, src, [(2, 1, "b", 0.0), (2, 1, "b", 0.0)])
    assert sorted(r.file_id for r in jobs.adopt_staged(spark, src, schema, out).collect()) == [1, 2, 2]


def test_sweep(spark, tmp_path):
    for name, age in (("handoff/a", 7200), ("outbox/b", 7200), ("outbox/c", 60)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
        os.utime(p, (1_700_000_000 - age,) * 2)
    now = dt.datetime.fromtimestamp(1_700_000_000)
    found = jobs.leftovers(spark, [str(tmp_path / "handoff"), str(tmp_path / "outbox")])
    assert sorted(r.path[-1] for r in jobs.expired(found, now).collect()) == ["a", "b"]


@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_queries_equal_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("events", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(streams.SQL[name])
        names = [d[0] for d in want.description]
        want = want.fetchall()
    got = streams.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want, key=str)

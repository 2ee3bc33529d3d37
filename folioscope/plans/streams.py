"""Registered streaming queries: they drain the table as a stream into the shared folder and return what it holds then."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def staged(spark, sf_dir, name):
    """Pattern and schema of a table as a stream's source; the pattern lets the table be one file or a folder of them."""
    return f"{sf_dir}/{name}.parque[t]", spark.read.parquet(f"{sf_dir}/{name}.parquet").schema


def run_events(spark, sf_dir):
    events = jobs.arriving(spark, *staged(spark, sf_dir, "events"))
    fraction = (F.col("event_id") % 101).cast("double") / 100
    return events.select(F.col("user_id").alias("file_id"), F.struct("ts", "event_id").alias("at"), "event_type", fraction.alias("fraction"))


def drained(spark, states, name):
    folder = shared_folder(spark, name)
    jobs.drain_states(states, folder)
    return jobs.latest(spark, folder, "file_id", states.schema)


@query("""SELECT user_id AS file_id, max(CAST(event_id % 101 AS DOUBLE) / 100) AS shown,
  arg_max(CAST(event_id % 101 AS DOUBLE) / 100, (ts, event_id)) AS reported, count(*) AS events FROM events GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    """X2."""
    return drained(spark, jobs.progress(run_events(spark, sf_dir)), "progress")


@query("""SELECT *, CASE WHEN endings = 0 THEN 'open' WHEN endings > 1 OR last NOT IN ('purchase', 'error') THEN 'broken' WHEN last = 'error' THEN 'failed' ELSE 'finished' END AS state
  FROM (SELECT user_id AS file_id, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS progress, count(*) FILTER (event_type IN ('purchase', 'error')) AS endings,
    arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)""")
def stream_lifecycle(spark, sf_dir):
    """X1."""
    return drained(spark, jobs.lifecycle(run_events(spark, sf_dir)), "lifecycle")


@query("SELECT conv_id, turn, role, text FROM conversations")
def stream_adopted(spark, sf_dir):
    """X3."""
    return jobs.adopt_staged(spark, *staged(spark, sf_dir, "conversations"), shared_folder(spark, "adopted")).select("conv_id", "turn", "role", "text")


@query("""SELECT event_id, ts AS modified FROM events WHERE event_type IN ('view', 'click') AND ts < (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""")
def expired_entries(spark, sf_dir):
    """Views and clicks stand for the entries of two shared folders, the newest event for the time of the sweep."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max("ts").alias("now")).first().now
    return jobs.expired(events.where(F.col("event_type").isin("view", "click")).select("event_id", F.col("ts").alias("modified")), now)

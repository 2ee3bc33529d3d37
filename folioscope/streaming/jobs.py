"""Structured Streaming jobs over run events and staged files.

Each job drains what has arrived (``availableNow``) and remembers in its checkpoint how far it came, so the next run
goes on from there and a lost executor or driver costs no row. Aggregations are Spark's own, with partial sums in front
of the shuffle: a file with a third of all events costs one row for each task. State holds one row for each file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Events that end a run (fixed values of the stand-in data): an outcome, or an error.
OUTCOME, ERROR = "purchase", "error"
#: Seconds after which what was left behind in a shared folder goes (fixed value).
LEFTOVER_AGE = 3600


def arriving(spark: SparkSession, path: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def drain_states(states: DataFrame, folder: str) -> None:
    """Write each batch's changed states to its own part of a table; a batch that is repeated replaces its part."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, key: str, schema: StructType) -> DataFrame:
    """The newest state of each key, in the columns of schema."""
    names = [n for n in schema.names if n != key]
    seen = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(f"{folder}/states")
    return seen.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(key, "s.*").select(schema.names)


def progress(events: DataFrame) -> DataFrame:
    """The fraction shown for each file, which never goes back, beside what its last event said.

    events: file_id, at (orderable), fraction.
    """
    return events.groupBy("file_id").agg(F.max("fraction").alias("shown"), F.max_by("fraction", "at").alias("reported"), F.count("*").alias("events"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Whether a file's events are progress and then exactly one ending. ``open`` files were cancelled or still run.

    events: file_id, at (orderable), event_type.
    """
    ends = F.col("event_type").isin(OUTCOME, ERROR)
    seen = events.groupBy("file_id").agg(F.count_if(~ends).alias("progress"), F.count_if(ends).alias("endings"), F.max_by("event_type", "at").alias("last"))
    state = F.when(F.col("endings") == 0, "open").when((F.col("endings") > 1) | ~F.col("last").isin(OUTCOME, ERROR), "broken").when(F.col("last") == ERROR, "failed").otherwise("finished")
    return seen.withColumn("state", state)


def adopt_staged(spark: SparkSession, staged: str, schema: StructType, folder: str, remove: bool = False) -> DataFrame:
    """File what was staged since the last run, each file once; all that has been adopted so far comes back.

    With ``remove`` staged files are deleted once a later run finds them adopted.
    """
    reader = spark.readStream.schema(schema)
    if remove:
        reader = reader.option("cleanSource", "delete")
    sink = reader.parquet(staged).writeStream.format("parquet").option("path", f"{folder}/adopted")
    sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/adopted")


def expired(entries: DataFrame, now, age: int = LEFTOVER_AGE) -> DataFrame:
    """Entries (modified, ...) that a sweep at ``now`` removes: those older than ``age`` seconds."""
    return entries.where(F.col("modified") < F.lit(now) - F.make_dt_interval(secs=F.lit(age)))


def leftovers(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """(path, modified, length) of the files in shared folders; their content isn't read."""
    files = spark.read.format("binaryFile").load(list(folders))
    return files.select("path", F.col("modificationTime").alias("modified"), "length")

"""Helpers that the training-data operators share: row selection, shared scratch space, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of the white space that the word operators cut at.
SPACE = r"[\x20\x09-\x0D]+"


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; every other column is left behind, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared spark.checkpoint.dir (its own temp folder if unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own value is eight times as large.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in small batches, which bounds memory on both sides; a user's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(name)).rstrip("b") == str(64 << 20):
        spark.conf.set(name, BATCH_BYTES)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What frees the caches of encoders in a worker process; workers outlive a stage, and the next may need the memory.
releases: list[Callable[[], None]] = []


def release_caches() -> None:
    for f in releases:
        f()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply ``make()`` (called once for each task) to column lists of each Arrow batch, 1024 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        f, out = make(), arrow_schema
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    arrow_schema = spark_to_arrow(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[str | None], bool]], text_col: str = "text") -> DataFrame:
    """Whole rows, all columns as they are, whose text ``make()`` (called once for each task) says to keep."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        f = make()
        for b in batches:
            yield b.filter(pa.array([f(t.as_py()) for t in b.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def spark_to_arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema)


def fold_of(doc_id: int | None, n: int) -> int:
    """crc32 of the id as decimal text, modulo n (a null id counts as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold(id_col: str, n: int):
    """The same as a column."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)

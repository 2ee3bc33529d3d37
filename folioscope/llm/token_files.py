"""Operator 5, token files: flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

Documents are range-partitioned by doc_id and each partition writes three files into one folder of the shared store:
``<part>.ids`` (ids of all its documents, unsigned 16-bit where the vocabulary fits, else 32-bit), ``<part>.off``
(unsigned 64-bit starts within the part, one more than documents) and ``<part>.doc`` (signed 64-bit doc_ids). Files
get their names by renaming, so a repeated task leaves the same files. What the driver holds is one row for each
part; prefix sums over these rows give each part's base, and base + offset is a document's place in the whole.

Defined cases: a null or empty text is the end id alone; null doc_ids sort first and come back as null; rows that
repeat a doc_id lie beside each other, ties by text; very long texts need the memory of one document; an empty table
gives an empty index; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, scratch
from .piece_encoder import KEEP, shared_encoder

NULL_ID = -(1 << 63)
#: Text bytes that a part should hold at most, on average.
PART_BYTES = 32 << 20


class Folder:
    """Files of one folder in the shared store: plain files where it is mounted, else through its file system."""

    def __init__(self, uri: str):
        at = urlparse(uri)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.path = at.path or uri
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def put(self, name: str, parts: Iterator[bytes]) -> None:
        tmp, final = f"{self.path}/.{name}.{uuid.uuid4().hex}", f"{self.path}/{name}"
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            with open(tmp, "wb") as f:
                for p in parts:
                    f.write(p)
            os.replace(tmp, final)
        else:
            self.fs.create_dir(self.path, recursive=True)
            with self.fs.open_output_stream(tmp) as f:
                for p in parts:
                    f.write(p)
            self.fs.move(tmp, final)

    def map(self, name: str, dtype) -> np.ndarray:
        """The file as an array: memory-mapped if it is mounted."""
        if self.local:
            path = f"{self.path}/{name}"
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read_buffer(), dtype)


def write_token_files(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, vocabulary: int = 50_257, parts: int | None = None, keep: int = KEEP) -> str:
    """Encode every text and write the folder; returns its URI. index.json there holds what the prefix sums gave."""
    spark = docs.sparkSession
    rows = id_text(docs)
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES), spark.sparkContext.defaultParallelism if size > PART_BYTES else 1)
    out = scratch(spark, "tokens")
    wide = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(tokenizer, kind, keep)
        tail = np.array([end_id], wide).tobytes()
        sizes, ids = array("Q", [0]), array("q")
        part = f"{TaskContext.get().partitionId():06d}"

        def tokens():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = enc.encode(t.as_py())
                    if wide != "<u2":
                        raw = np.frombuffer(raw, "<u2").astype(wide).tobytes()
                    ids.append(NULL_ID if i is None else i)
                    sizes.append(sizes[-1] + len(raw) // int(wide[-1]) + 1)
                    yield raw + tail

        folder = Folder(out)
        folder.put(f"{part}.ids", tokens())
        folder.put(f"{part}.off", iter([sizes.tobytes()]))
        folder.put(f"{part}.doc", iter([ids.tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([int(part)], pa.int32()), "docs": [len(ids)], "tokens": [int(sizes[-1])]})

    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = sorted(ranged.mapInArrow(write, "part int, docs long, tokens long").collect())
    base, index = 0, []
    for r in made:
        index.append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    Folder(out).put("index.json", iter([json.dumps({"dtype": wide, "end_id": end_id, "parts": index}).encode()]))
    return out


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: a task maps one part at a time."""
    index = json.loads(bytes(Folder(uri).map("index.json", np.uint8)))
    parts = [(p["part"], p["base"]) for p in index["parts"]]
    wide = index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for b in batches:
            for k in b.column(0).to_pylist():
                part, base = parts[k]
                ids, off, doc = folder.map(f"{part:06d}.ids", wide), folder.map(f"{part:06d}.off", "<u8"), folder.map(f"{part:06d}.doc", "<i8")
                for at in range(0, len(doc), 1024):
                    o = off[at : at + 1025].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if d == NULL_ID else int(d) for d in doc[at : at + 1024]], pa.int64()),
                        "start": o[:-1] + base,
                        "n_tokens": np.diff(o),
                        "ids_crc32": pa.array([zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(o[:-1], o[1:], strict=True)], pa.int64()),
                    })

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, keep: int = KEEP) -> DataFrame:
    """Write the files, then read them back. keep: see KEEP; it bears on speed only."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, "byte", end_id, keep=keep))

"""Scalar functions on names, byte counts, filters and transforms, and byte checksums in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short filter names and what they stand for.
ALIASES = {"Fl": "flate", "FlateDecode": "flate", "LZW": "lzw", "LZWDecode": "lzw", "A85": "ascii85", "ASCII85Decode": "ascii85", "AHx": "asciiHex", "ASCIIHexDecode": "asciiHex", "RL": "runLength", "RunLengthDecode": "runLength", "DCT": "dct", "DCTDecode": "dct", "CCF": "ccitt", "CCITTFaxDecode": "ccitt", "JPXDecode": "jpx", "JBIG2Decode": "jbig2"}
DECIDING, GENERIC = ("dct", "jpx", "ccitt", "jbig2"), ("flate", "lzw", "runLength")


def output_name(name: Column) -> Column:
    """only the last extension goes."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-reduced.pdf"))


def safe_name(name: Column) -> Column:
    """F40."""
    clean = F.trim(F.translate(name, "/:", "--"))
    return F.when(clean == "", "Document.pdf").otherwise(clean)


def renamed(name: Column) -> Column:
    """null for an empty name; the extension's case counts."""
    clean = F.trim(name)
    return F.when(clean == "", None).when(clean.endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))


def byte_amount(b: Column) -> tuple[Column, Column]:
    """unit, and the number at that unit's precision."""
    big = b >= 1_000_000
    return F.when(big, "MB").otherwise("KB"), F.when(big, F.round(b / 1_000_000.0, 1)).otherwise(F.round(b / 1_000.0, 0))


def target_bytes(megabytes: Column) -> Column:
    """0.1 to 500 MB, truncated."""
    return F.floor(F.least(F.lit(500.0), F.greatest(F.lit(0.1), megabytes)) * 1_000_000).cast("long")


def percent_saved(original: Column, final: Column) -> Column:
    """0 where there was nothing."""
    return F.when((original <= 0) | (final <= 0), 0).otherwise(F.round(100 * (1 - F.try_divide(final.cast("double"), original.cast("double")))).cast("long"))


def image_filter(names: Column) -> Column:
    """F6, F7, G5."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), n))
    last = F.try_element_at(F.filter(plain, lambda n: n.isin(*DECIDING)), F.lit(-1))
    out = F.when(last.isNotNull(), last)
    for g in GENERIC:
        out = out.when(F.array_contains(plain, g), g)
    return out.when(F.size(plain) > 0, "other").otherwise("none")


def concatenated(m: tuple, n: tuple) -> tuple[Column, ...]:
    """m applied in front of n; (a, b, c, d, tx, ty)."""
    a, b, c, d, x, y = m
    e, f, g, h, u, v = n
    return a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h, x * e + y * g + u, x * f + y * h + v


def page_numbers(text: Column) -> Column:
    """F43."""
    numbers = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("long"))
    return F.filter(numbers, lambda n: n > 0)


def survived(before: Column, after: Column) -> Column:
    """how much of a document's text is still there."""
    share = F.try_divide(after.cast("double"), before.cast("double"))
    return F.when(before.isNull(), "?").when(before == 0, "n/a").when(after == 0, "LOST").when(share >= 0.98, "yes").otherwise(F.concat(F.round(100 * share).cast("long").cast("string"), F.lit("%")))


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a, wrapping."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def deflated(data: bytes) -> bytes | None:
    """the zlib stream if it is smaller."""
    out = zlib.compress(data)
    return out if len(out) < len(data) else None


def checksums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fnv1a (hexadecimal, of the id's digits), adler32 and deflated length (null if not smaller) of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(0).to_pylist(), [(t or "").encode() for t in b.column(1).to_pylist()]
            small = [deflated(r) for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{fnv1a(str(i).encode()):016x}" for i in ids]), pa.array([zlib.adler32(r) for r in raw], pa.int64()), pa.array([None if s is None else len(s) for s in small], pa.int64())], ["doc_id", "fnv1a", "adler32", "deflated"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, fnv1a string, adler32 long, deflated long")


def page_box(crop_w: Column, crop_h: Column, media_w: Column, media_h: Column) -> tuple[Column, Column]:
    """Width and height of the crop box where it has an area, else of the media box."""
    cropped = F.coalesce((crop_w > 0) & (crop_h > 0), F.lit(False))
    return F.when(cropped, crop_w).otherwise(media_w), F.when(cropped, crop_h).otherwise(media_h)

"""Views over the star-schema tables that stand in for scanned documents.

Each view is plain SQL that Spark and DuckDB both run, so a query and its check start from the same text. The views are
test inputs of our own making: a document is a supplier, a page holds its line items, an image object is a part, and
content ids repeat so that objects share content and cheap keys. Low content ids give keys of their own (uncontested).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Place of a line item among those of its supplier.
SCAN_ORDER = "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT)"

#: One row for each draw of an image on a page. scan_order is the order in which a document's draws are met.
IMAGE_USAGE = f"""
SELECT doc_id, page_index, scan_order, object_id, content_id, pixel_w, pixel_h, bpc, components, flt, raw_len,
       drawn_w, drawn_h, mask_w, mask_h, mask_len, mask_matte, mask_decode, has_colour_key, has_decode, is_stencil,
       CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h
FROM (
  SELECT l_suppkey AS doc_id, l_orderkey % 40 AS page_index,
         {SCAN_ORDER} AS scan_order,
         l_partkey AS object_id, l_partkey % 97 AS content_id,
         200 + 40 * ((CASE WHEN l_partkey % 97 < 60 THEN l_partkey % 97 % 24 ELSE l_partkey % 97 END) % 50) AS pixel_w,
         150 + 30 * ((CASE WHEN l_partkey % 97 < 60 THEN l_partkey % 97 % 24 ELSE l_partkey % 97 END) % 40) AS pixel_h,
         CASE WHEN l_partkey % 97 % 24 = 3 THEN 1 WHEN l_partkey % 97 % 24 = 5 THEN 4 ELSE 8 END AS bpc,
         CASE WHEN l_partkey % 97 % 24 = 7 THEN 0 WHEN l_partkey % 97 % 3 = 0 THEN 1 ELSE 3 END AS components,
         CASE l_partkey % 97 % 24 % 6 WHEN 0 THEN 'flate' WHEN 1 THEN 'dct' WHEN 2 THEN 'lzw' WHEN 3 THEN 'jbig2' WHEN 4 THEN 'dct' ELSE 'none' END AS flt,
         CAST(5000 + 977 * ((CASE WHEN l_partkey % 97 < 60 THEN l_partkey % 97 % 24 ELSE l_partkey % 97 END) % 60) AS BIGINT) AS raw_len,
         CAST(l_quantity AS DOUBLE) * 12.0 AS drawn_w, CAST(l_quantity AS DOUBLE) * 15.0 AS drawn_h,
         CASE WHEN l_partkey % 97 % 8 = 2 THEN 100 END AS mask_w, CASE WHEN l_partkey % 97 % 8 = 2 THEN 80 END AS mask_h,
         CASE WHEN l_partkey % 97 % 8 = 2 THEN CAST(700 AS BIGINT) END AS mask_len,
         l_partkey % 97 % 16 = 10 AS mask_matte, l_partkey % 97 % 32 = 18 AS mask_decode,
         l_partkey % 97 % 24 = 11 AS has_colour_key, l_partkey % 97 % 24 = 13 AS has_decode, l_partkey % 97 % 24 = 17 AS is_stencil
  FROM lineitem
) AS placed
"""

#: One row for each page of a document, drawn on or not (the last of each has no image); a third of the pages have no text.
PAGE = """
SELECT doc_id, page_index, max(page_w * page_h) AS page_area, count(*) AS image_count, sum(raw_len) AS image_bytes,
       max(CASE WHEN page_w * page_h <= 0.01 THEN 0 ELSE drawn_w * drawn_h / (page_w * page_h) END) AS max_coverage,
       CASE WHEN (doc_id + page_index) % 3 = 0 THEN 0 ELSE 1 + (doc_id + page_index) % 50 END AS text_ops
FROM image_usage GROUP BY doc_id, page_index
UNION ALL SELECT s_suppkey, 40, CAST(612 * 792 AS DOUBLE), 0, 0, CAST(0 AS DOUBLE), s_suppkey % 4 FROM supplier
"""

#: One row for each document: file size, and what an independent count of its raw image objects says.
DOCUMENT = """
SELECT doc_id, CAST(40000 + sum(object_bytes) + 3000 * (doc_id % 7) AS BIGINT) AS byte_size, count(*) AS resolved_objects,
       count(*) + CASE WHEN doc_id % 11 = 0 THEN CAST(floor(count(*) / 2) AS BIGINT) WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS raw_objects,
       doc_id % 23 = 0 AS is_locked
FROM (SELECT doc_id, object_id, max(raw_len + coalesce(mask_len, 0)) AS object_bytes FROM image_usage GROUP BY doc_id, object_id) AS o
GROUP BY doc_id
"""

#: Every image object stored in a document, some of which no page draws.
OBJECT = """
SELECT DISTINCT doc_id, object_id FROM image_usage
UNION ALL SELECT s_suppkey, 1000000000 + c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey
"""

#: The four measured profiles (fixed values).
PROFILE = """
SELECT profile_id, CAST(target_dpi AS DOUBLE) AS target_dpi, CAST(jpeg_quality AS DOUBLE) AS jpeg_quality, gray_scans, recodes FROM (VALUES ('lossless', 300.0, 0.85, false, false), ('sendIt', 150.0, 0.65, false, true),
  ('small', 110.0, 0.50, false, true), ('tiny', 72.0, 0.35, true, true)) AS t(profile_id, target_dpi, jpeg_quality, gray_scans, recodes)
"""

#: Runs of a file: a user's events in order, the value as bytes.
RUN = """
SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pass,
       CAST(floor(value * 10000) AS BIGINT) AS bytes, CAST(event_id % 101 AS DOUBLE) / 100 AS fraction, event_type
FROM events
"""

VIEWS = {"image_usage": IMAGE_USAGE, "page": PAGE, "document": DOCUMENT, "object": OBJECT, "profile": PROFILE, "run": RUN}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_views(body: str, *more: tuple[str, str], views: dict[str, str] = VIEWS) -> str:
    """A statement that defines, in front of body, the views it names (and those that these name), then more."""
    used, text = [], body + " ".join(s for _, s in more)
    for name in reversed(views):
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
            used.append(name)
            text += views[name]
    parts = [f"{n} AS ({views[n]})" for n in views if n in used] + [f"{n} AS ({s})" for n, s in more]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


#: Line items in a partition of the views, on average, which bounds a task's sorts and groups.
SPREAD_ROWS = 100_000


def spread_usage(parts: int) -> str:
    """IMAGE_USAGE for Spark: line items are dealt by document and put in order with their own columns only.

    What follows from these columns is computed behind the sort, and what groups by document needs no other shuffle.
    """
    lines = f"SELECT /*+ REPARTITION({parts}, l_suppkey) */ l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem"
    given = f"(SELECT l_suppkey, l_orderkey, l_partkey, l_quantity, {SCAN_ORDER} AS scan_order FROM ({lines}) AS l) AS lines"
    return IMAGE_USAGE.replace(SCAN_ORDER, "scan_order").replace("FROM lineitem", f"FROM {given}")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables of a folder, made once in a session while it is about the same folder."""
    if spark.conf.get("folioscope.tables", None) == sf_dir:
        return
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    spark.conf.set("folioscope.tables", sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    register(spark, sf_dir)
    return spark.sql(with_views(f"SELECT * FROM {name}", views=VIEWS | {"image_usage": spread_usage(usage_parts(spark, sf_dir))}))


def usage_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the line items by document: as many as their number asks for, counted once in a session for each folder."""
    known = spark.conf.get("folioscope.usage_parts", "").split(" ", 1)
    if known[1:] != [sf_dir]:
        n = spark.table("lineitem").count()
        cores = spark.sparkContext.defaultParallelism if n > SPREAD_ROWS else 1
        known = [str(max(cores, -(-n // SPREAD_ROWS))), sf_dir]
        spark.conf.set("folioscope.usage_parts", " ".join(known))
    return int(known[0])

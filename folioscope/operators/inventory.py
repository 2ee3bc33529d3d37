"""Inventory operators: what a document stores, what of it is stored twice, and how its pages are built.

Each takes DataFrames of the shapes in ``sources.adapters`` and returns a DataFrame; identifiers in docstrings name the
rows of the operator inventory. Only contested keys, which several objects have, are told apart by content. Everything
about a draw is found by windows within its document, so usages that are dealt by document aren't shuffled again.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["pixel_w", "pixel_h", "bpc", "raw_len", "flt"]
UNDECODABLE = ("ccitt", "jbig2", "other")


def decline_reason() -> Column:
    """The first reason that holds, in this order; null for an image that can be re-encoded."""
    c = F.col
    return (
        F.when((c("bpc") == 1) | c("is_stencil"), "bilevel")
        .when(c("flt").isin(*UNDECODABLE), "undecodableFilter")
        .when(c("components") < 1, "unresolvableColorSpace")
        .when(c("has_decode"), "decodeArray")
        .when(c("has_colour_key"), "colourKeyMask")
        .when(c("mask_w").isNotNull() & c("mask_matte"), "matte")
        .when(c("mask_w").isNotNull() & c("mask_decode"), "maskUndecodable")
    )


def effective_dpi() -> Column:
    """pixels over drawn inches; 0 where nothing is drawn."""
    return F.when(F.col("drawn_w") <= 0.01, 0.0).otherwise(F.col("pixel_w") / (F.when(F.col("drawn_w") <= 0.01, 1.0).otherwise(F.col("drawn_w")) / 72.0))


def coverage() -> Column:
    """drawn area over page area; 0 for an empty page."""
    area = F.col("page_w") * F.col("page_h")
    return F.when(area <= 0.01, 0.0).otherwise(F.col("drawn_w") * F.col("drawn_h") / F.when(area <= 0.01, 1.0).otherwise(area))


def described(usage: DataFrame) -> DataFrame:
    """Every usage with reason, recodable, alpha, dpi, coverage and total length."""
    return usage.withColumns({
        "reason": decline_reason(),
        "dpi": effective_dpi(),
        "coverage": coverage(),
        "total_len": F.col("raw_len") + F.coalesce("mask_len", F.lit(0)),
        "has_alpha": F.col("mask_w").isNotNull() | F.col("has_colour_key"),
    }).withColumn("recodable", F.col("reason").isNull())


def contested_keys(usage: DataFrame) -> DataFrame:
    """A10: keys that several objects of a document share. Draws of one object don't count: two-level aggregation."""
    objects = usage.select("doc_id", *KEY, "object_id").distinct()
    return objects.groupBy("doc_id", *KEY).agg(F.count("*").alias("objects")).where("objects > 1")


def identified(usage: DataFrame) -> DataFrame:
    """The content digest for contested keys, else a digest of the key, never equal to one of content.

    A key is contested if its least and greatest object differ, which a window by document and key tells without a join.
    """
    same = W.partitionBy("doc_id", *KEY)
    whole = reduce(and_, [F.col(k).isNotNull() for k in ("doc_id", *KEY)])
    key = F.sha2(F.concat(F.lit("key\u0000"), F.concat_ws(";", *[F.col(k).cast("string") for k in KEY])), 256)
    content = F.sha2(F.concat_ws(";", F.col("content_id").cast("string"), F.col("components").cast("string"), F.coalesce(F.col("mask_w").cast("string"), F.lit("-"))), 256)
    marked = usage.withColumn("contested", F.coalesce(whole & (F.min("object_id").over(same) < F.max("object_id").over(same)), F.lit(False)))
    return marked.withColumn("identity", F.when(F.col("contested"), content).otherwise(key))


def first_seen(usage: DataFrame) -> DataFrame:
    """Of each identity the draw that was met first."""
    w = W.partitionBy("doc_id", "identity").orderBy("scan_order")
    return usage.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def canonical(usage: DataFrame) -> DataFrame:
    """Of each identity the largest draw; the first of equals."""
    w = W.partitionBy("doc_id", "identity").orderBy((F.col("drawn_w") * F.col("drawn_h")).desc(), "scan_order")
    return usage.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What ``images`` adds up: sums over the images of a document are the document's.
SUMS = ["placements", "raw_object_bytes", "raw_unique_bytes", "distinct_images", "raw_addressable_bytes", "contested_keys"]


def images(usage: DataFrame) -> DataFrame:
    """``canonical`` draws of ``described`` usages with SUMS, which are what each image adds to its document.

    Every draw has one identity, so a document's draws, its objects (with their first draw) and its contested keys (with
    theirs) are counted with the identity where they are met. All of it takes one pass of windows within the document,
    which sort one after another, so what a task holds doesn't grow with the number of figures.
    """
    c = F.col
    of_object, of_key, of_image = W.partitionBy("doc_id", "object_id"), W.partitionBy("doc_id", *KEY), W.partitionBy("doc_id", "identity")
    d = described(usage)
    d = d.withColumn("_object", F.row_number().over(of_object.orderBy("scan_order"))).withColumn("_own", F.max("total_len").over(of_object))
    d = d.withColumn("_key", F.row_number().over(of_key.orderBy("scan_order"))).withColumn("_several", F.min("object_id").over(of_key) < F.max("object_id").over(of_key))
    d = identified(d).withColumn("_n", F.row_number().over(of_image.orderBy((c("drawn_w") * c("drawn_h")).desc(), "scan_order")))
    return d.withColumns({
        "placements": F.count("*").over(of_image),
        "raw_object_bytes": F.sum(F.when(c("_object") == 1, c("_own"))).over(of_image),
        "raw_unique_bytes": F.min_by("total_len", "scan_order").over(of_image),
        "distinct_images": F.lit(1).cast("long"),
        "raw_addressable_bytes": F.when(c("recodable"), c("total_len")).otherwise(0),
        "contested_keys": F.sum(F.when((c("_key") == 1) & c("_several"), 1).otherwise(0)).over(of_image),
    }).where("_n = 1").drop("_object", "_own", "_key", "_several", "_n")


def page_class() -> Column:
    """P4."""
    return F.when(F.col("image_count") == 0, "vectorOnly").when((F.col("max_coverage") >= 0.85) & (F.col("text_ops") == 0), "scanLike").otherwise("mixed")


def stored(sums: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with rows of (doc_id, SUMS), and what follows from them. Other columns stay."""
    d = documents.join(sums, "doc_id")
    d = d.withColumn("object_bytes", F.least("raw_object_bytes", "byte_size")).withColumn("unique_bytes", F.least("raw_unique_bytes", "byte_size"))
    share = lambda c: F.when(F.col("byte_size") <= 0, 0.0).otherwise(F.col(c) / F.when(F.col("byte_size") <= 0, 1).otherwise(F.col("byte_size")))
    d = d.withColumn("non_image_bytes", F.greatest(F.lit(0), F.col("byte_size") - F.col("object_bytes"))).withColumn("duplicate_bytes", F.greatest(F.lit(0), F.col("object_bytes") - F.col("unique_bytes")))
    return d.withColumn("image_fraction", share("object_bytes")).withColumn("duplicate_fraction", share("duplicate_bytes"))


def storage(usage: DataFrame, documents: DataFrame) -> DataFrame:
    """Bytes stored, bytes distinct, shares and verdicts of each document."""
    d = stored(images(usage).groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in SUMS]), documents)
    return d.select(
        "doc_id", "byte_size", "placements", "distinct_images", "object_bytes", "unique_bytes", "non_image_bytes", "duplicate_bytes", "image_fraction", "duplicate_fraction",
        (F.col("image_fraction") >= 0.20).alias("worth_compressing"), (F.col("duplicate_fraction") >= 0.25).alias("worth_deduplicating"),
    )


def declines(usage: DataFrame) -> DataFrame:
    """A5: declined distinct images by document and reason."""
    return canonical(identified(described(usage))).where("reason IS NOT NULL").groupBy("doc_id", "reason").agg(F.count("*").alias("images"), F.sum("total_len").alias("bytes"))


def addressable(usage: DataFrame) -> DataFrame:
    """Bytes of distinct images that can be re-encoded."""
    return canonical(identified(described(usage))).groupBy("doc_id").agg(F.sum(F.when(F.col("recodable"), F.col("total_len")).otherwise(0)).alias("addressable_bytes"))


def object_loss(documents: DataFrame) -> DataFrame:
    """Refusal before any work; locked first, then too many objects that don't resolve."""
    lost = F.greatest(F.lit(0), F.col("raw_objects") - F.col("resolved_objects"))
    d = documents.withColumn("unresolved", lost)
    gone = (F.col("raw_objects") > 0) & (F.col("unresolved") >= 3) & (F.col("unresolved") > 0.25 * F.col("raw_objects"))
    return d.select("doc_id", "raw_objects", "resolved_objects", "unresolved", F.when(F.col("is_locked"), "locked").when(gone, "objectsLost").alias("refusal"))


def admission(usage: DataFrame, documents: DataFrame, available: int = 0) -> DataFrame:
    """Whether a small process may take the document; 0 available means unknown and skips that test."""
    big = usage.groupBy("doc_id").agg(F.max(F.col("pixel_w").cast("long") * F.col("pixel_h")).alias("largest_pixels"), F.max(F.col("pixel_w").cast("long") * F.col("pixel_h") * F.greatest(F.lit(1), F.col("components"))).alias("largest_samples"))
    d = documents.join(big, "doc_id").withColumn("estimated_peak", 60_000_000 + 4 * F.col("largest_samples"))
    ok = (F.col("byte_size") <= 30_000_000) & (F.col("largest_pixels") <= 12_000_000) & (F.lit(available <= 0) | (F.col("estimated_peak") < available))
    return d.select("doc_id", "largest_pixels", "estimated_peak", ok.alias("admitted"))

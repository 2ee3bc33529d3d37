"""Size predictions over profiles and the search for a setting that meets a byte target.

No image codec is part of the library: every size here is the model's prediction, never an achieved size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inventory

#: Fixed values of the size model.
BITS_BASE, BITS_SLOPE, MASK_BITS, RASTER_FACTOR, GRAY_FACTOR, OVERHEAD = 0.14, 2.4, 0.35, 0.65, 0.70, 60
#: Fixed values of the settings: the range of resolution and quality, and where scans turn grey.
TOP_DPI, FLOOR_DPI, TOP_Q, FLOOR_Q, GRAY_AT = 300.0, 72.0, 0.85, 0.30, 0.75
#: Fixed values of the search.
AIM, GOOD, NUDGE, LEAST_STEP, DAMPED, DAMPED_CAP, PASSES = 0.92, 0.80, 0.02, 0.08, 0.35, 0.5, 4


def truncated(c: Column) -> Column:
    return F.floor(c).cast("long")


def bits_per_pixel(quality: Column) -> Column:
    """F11."""
    return BITS_BASE + BITS_SLOPE * quality


def scale(dpi: Column, target: Column) -> Column:
    """never enlarge; images without a resolution stay as they are."""
    return F.when(dpi <= 1, 1.0).otherwise(F.least(F.lit(1.0), target / F.when(dpi <= 1, 1.0).otherwise(dpi)))


def projected(target: Column, quality: Column) -> Column:
    """image and mask (on the image's grid at most) truncated apart, and no more than what is there. Columns of ``described`` usages."""
    s = scale(F.col("dpi"), target)
    pixels = F.col("pixel_w") * F.col("pixel_h") * s * s
    image = truncated(pixels * bits_per_pixel(quality) / 8)
    mask = F.coalesce(truncated(F.least(pixels, F.col("mask_w") * F.col("mask_h") * s * s) * MASK_BITS / 8), F.lit(0))
    return F.when(F.col("reason").isNotNull(), F.col("total_len")).otherwise(F.least(F.col("total_len"), image + mask))


def raster_bytes(area: Column, target: Column, quality: Column, gray: Column) -> Column:
    """a page of this many square points as one image."""
    return truncated(area / 5184 * target * target * bits_per_pixel(quality) * RASTER_FACTOR * F.when(gray, GRAY_FACTOR).otherwise(1.0) / 8)


def page_classes(pages: DataFrame) -> DataFrame:
    """P4, A4's input."""
    return pages.withColumn("page_class", inventory.page_class())


def sized(usage: DataFrame, pages: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, profile_id, predicted) of every document under every profile, with the columns of
    ``inventory.stored`` and scan_pages. The profile table has four rows.

    Draws are gone through once. Images and scans are added up by page, where an image on a scan gives way to its raster.
    """
    c = F.col
    p, page = F.broadcast(profiles), ["doc_id", "page_index", "profile_id", "recodes"]
    drawn = inventory.images(usage).crossJoin(p).groupBy(*page).agg(F.sum(projected(c("target_dpi"), c("jpeg_quality"))).alias("image_part"), *[F.sum(k).alias(k) for k in inventory.SUMS])
    scans = page_classes(pages).where("page_class = 'scanLike'").crossJoin(p)
    scans = scans.groupBy(*page).agg(F.sum(raster_bytes(c("page_area"), c("target_dpi"), c("jpeg_quality"), c("gray_scans"))).alias("raster_part"), F.count("*").alias("scan_pages"))
    sums = [*inventory.SUMS, "raster_part", "scan_pages"]
    each = drawn.unionByName(scans, allowMissingColumns=True).groupBy(*page).agg(*[F.sum(k).alias(k) for k in ("image_part", *sums)])
    stays = c("scan_pages").isNull() | c("page_index").isNull()
    each = each.groupBy("doc_id", "profile_id", "recodes").agg(F.sum(F.when(stays, c("image_part"))).alias("image_part"), *[F.sum(k).alias(k) for k in sums])
    d = inventory.stored(each.where("distinct_images > 0"), documents)
    lossy = c("non_image_bytes") + F.coalesce("raster_part", F.lit(0)) + F.coalesce("image_part", F.lit(0)) + OVERHEAD * c("distinct_images")
    lossless = c("non_image_bytes") + c("unique_bytes") + OVERHEAD * c("distinct_images")
    return d.withColumn("predicted", F.when(c("recodes"), lossy).otherwise(lossless)).withColumn("scan_pages", F.coalesce("scan_pages", F.lit(0)))


def estimates(usage: DataFrame, pages: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Predicted bytes of every document under every profile."""
    return sized(usage, pages, documents, profiles).select("doc_id", "profile_id", "predicted")


def aggression(dpi: Column) -> Column:
    """where a resolution lies between top (0) and floor (1), on a logarithmic scale."""
    clamped = F.least(F.lit(TOP_DPI), F.greatest(F.lit(FLOOR_DPI), dpi))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ln(clamped / TOP_DPI) / math.log(FLOOR_DPI / TOP_DPI)))


def setting(a: Column) -> tuple[Column, Column, Column]:
    """F16: resolution, quality and grey of an aggression."""
    return TOP_DPI * F.pow(F.lit(FLOOR_DPI / TOP_DPI), a), TOP_Q - (TOP_Q - FLOOR_Q) * a, a >= GRAY_AT


def curve(bytes_top: Column, bytes_floor: Column, a: Column) -> Column:
    """The size model between its two ends: geometric, so that a secant on its logarithm is well conditioned."""
    return truncated(bytes_top * F.pow(bytes_floor / bytes_top, a))


def next_aggression(a1: Column, b1: Column, a2: Column, b2: Column, n: Column, target: Column, too_big: Column, fits: Column, current: Column) -> Column:
    """the next setting from the last two measured points (a1, b1), (a2, b2), of which n are there.

    Two points give a secant on the logarithm of bytes, aimed under the target; one gives a damped step; none a fixed one.
    The proposal stays inside the bracket and never stands still.
    """
    aim = F.ln(target * AIM)
    rise, run = F.ln(b2) - F.ln(b1), a2 - a1
    usable = (F.abs(run) > 0.001) & (F.abs(rise) > 0.001)
    secant = F.when(usable, a2 + (aim - F.ln(b2)) * run / F.when(usable, rise).otherwise(1.0)).otherwise(a2 + F.when(b2 > target, LEAST_STEP).otherwise(-LEAST_STEP))
    damped = a2 + F.greatest(F.lit(-DAMPED_CAP), F.least(F.lit(DAMPED_CAP), (F.ln(b2) - aim) * DAMPED))
    raw = F.when(n >= 2, secant).when(n == 1, damped).otherwise(current + LEAST_STEP)
    open_ = too_big < fits
    raw = F.when(open_, F.least(F.greatest(raw, too_big + NUDGE), fits - NUDGE)).otherwise(raw)
    raw = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    step = current + F.when(raw >= current, LEAST_STEP).otherwise(-LEAST_STEP)
    moved = F.when(open_, F.least(F.greatest(step, too_big), fits)).otherwise(step)
    return F.least(F.greatest(F.when(F.abs(raw - current) < LEAST_STEP, moved).otherwise(raw), F.lit(0.0)), F.lit(1.0))


def search(candidates: DataFrame) -> DataFrame:
    """At most four passes for (doc_id, target, start, top, floor, lossless, non_image), as columns.

    lossless is the size after deduplication alone, null where nothing is stored twice; where it is there it is the first
    pass. A document that has landed keeps its state. The result is the largest that fits, else the smallest.
    """
    c = F.col
    d = candidates.withColumns({
        "a": c("start"), "recode": c("lossless").isNull(), "n": F.lit(0), "passes": F.lit(0), "too_big": F.lit(0.0), "fits": F.lit(1.0), "done": F.lit(False),
        **{k: F.lit(None).cast("double") for k in ("a1", "b1", "a2", "b2")}, **{k: F.lit(None).cast("long") for k in ("best", "least")},
    })
    for k in range(1, PASSES + 1):
        go, target = ~c("done"), c("target")
        d = d.withColumn("got", F.when(c("recode"), curve(c("top"), c("floor"), c("a"))).otherwise(c("lossless"))).withColumn("ok", c("got") <= target)
        d = d.withColumns({
            "passes": F.when(go, k).otherwise(c("passes")),
            "best": F.when(go & c("ok"), F.greatest(F.coalesce("best", "got"), c("got"))).otherwise(c("best")),
            "least": F.when(go, F.least(F.coalesce("least", "got"), c("got"))).otherwise(c("least")),
            "done": c("done") | (c("ok") & ~c("recode")) | (c("ok") & (c("got") >= GOOD * target)) | (c("non_image") >= target),
        })
        if k == PASSES:
            break
        point = ~c("done") & c("recode")
        d = d.withColumns({
            "a1": F.when(point, c("a2")).otherwise(c("a1")), "b1": F.when(point, c("b2")).otherwise(c("b1")),
            "a2": F.when(point, c("a")).otherwise(c("a2")), "b2": F.when(point, c("got").cast("double")).otherwise(c("b2")),
            "n": F.when(point, c("n") + 1).otherwise(c("n")),
            "too_big": F.when(point & ~c("ok"), F.greatest(c("too_big"), c("a"))).otherwise(c("too_big")),
            "fits": F.when(point & c("ok"), F.least(c("fits"), c("a"))).otherwise(c("fits")),
        }).withColumn("done", c("done") | (c("recode") & (c("a") >= 0.999) & ~c("ok")))
        follow = next_aggression(c("a1"), c("b1"), c("a2"), c("b2"), c("n"), target.cast("double"), c("too_big"), c("fits"), c("a"))
        if k == PASSES - 1:
            follow = F.when(c("best").isNull(), 1.0).otherwise(follow)
        d = d.withColumns({"a": F.when(c("done"), c("a")).otherwise(follow), "recode": F.lit(True)})
        d = d.drop("got", "ok")
    return d.select("doc_id", "target", "passes", F.coalesce("best", "least").alias("bytes"), F.when(c("best").isNotNull(), "met").otherwise("bestEffort").alias("outcome"))

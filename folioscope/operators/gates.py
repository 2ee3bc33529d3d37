"""Integrity gates: sampled pages, thumbnails, likeness, and the verdict on a produced document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import register

EXHAUSTIVE, SAMPLES, LEAST_LIKENESS = 25, 12, 0.75


def sample_indices(n: Column) -> Column:
    """All pages up to EXHAUSTIVE, else SAMPLES evenly spaced ones including both ends."""
    n = n.cast("long")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.least(n - 1, F.round(i * ((n - 1) / (SAMPLES - 1.0))).cast("long")))
    return F.when(n <= EXHAUSTIVE, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))).otherwise(F.array_sort(F.array_distinct(spaced)))


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pixels): vectors quantised to 0..255 stand in for 8 x 8 renders.

    Constants are floats, so that single values stay in single precision, as in the SQL; in doubles some fall below a whole number.
    """
    register(spark, sf_dir)
    black, one, half, white = (F.lit(v).cast("float") for v in (0, 1, 127.5, 255))
    return spark.table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.least(white, F.greatest(black, (x + one) * half))).cast("long")).alias("pixels"))


def correlation(a: Column, b: Column) -> Column:
    """two flat pages are alike, one flat page is unlike; null where lengths differ or nothing is there.

    One pass over both; whole pixel values keep every sum exact.
    """
    none = F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    add = lambda s, p: F.struct((s.x + p.x).alias("x"), (s.y + p.y).alias("y"), (s.xx + p.x * p.x).alias("xx"), (s.yy + p.y * p.y).alias("yy"), (s.xy + p.x * p.y).alias("xy"))

    def ratio(s: Column) -> Column:
        n = F.size(a).cast("double")
        va, vb = s.xx - s.x * s.x / n, s.yy - s.y * s.y / n
        return F.when((va <= 1e-6 * n) & (vb <= 1e-6 * n), 1.0).when((va <= 0) | (vb <= 0), 0.0).otherwise((s.xy - s.x * s.y / n) / (F.sqrt(va) * F.sqrt(vb)))

    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(pairs, none, add, ratio))


def box_average(pixels: Column, side: int, target: int) -> Column:
    """means of square blocks, truncated; null where pixels are missing."""
    k = side // target
    offsets = [dy * side + dx for dy in range(k) for dx in range(k)]

    def block(i: Column) -> Column:
        at = F.floor(i / target).cast("int") * (k * side) + (i % target) * k
        return F.floor(sum(F.get(pixels, at + o) for o in offsets) / (k * k)).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(target * target - 1)), block)


def verdict(opens: Column, pages: Column, expected: Column, blank: Column, likeness: Column, had_text: Column, has_text: Column) -> Column:
    """The first failure in this order; null if the document passes."""
    return (
        F.when(~opens, "cannotReopen")
        .when(pages != expected, "pageCountMismatch")
        .when(blank, "blankPage")
        .when(likeness < LEAST_LIKENESS, "pageDiverged")
        .when(had_text & ~has_text, "textVanished")
    )

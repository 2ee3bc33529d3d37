"""Known answers, loops in plain Python, and the SQL of each query on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import estimate, gates, inventory
from folioscope.plans import registry
from folioscope.sources.adapters import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{v:.6g}" if isinstance(v, (int, float, np.number)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)) for d in (got, want)]
    assert rows[0] == rows[1]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_known_answers(spark):
    assert list(one(spark, T.output_name(F.lit("2026.Q1.report.pdf")), T.output_name(F.lit("scan")))) == ["2026.Q1.report-reduced.pdf", "scan-reduced.pdf"]
    long, short = one(spark, gates.sample_indices(F.lit(900)), gates.sample_indices(F.lit(9)))
    assert long == [0, 82, 163, 245, 327, 409, 490, 572, 654, 736, 817, 899] and short == list(range(9))
    got = one(spark, *[estimate.aggression(F.lit(float(x))) for x in (150, 110, 72)])
    assert [round(x, 6) for x in got] == [0.485698, 0.703028, 1.0]
    assert T.fnv1a(b"") == 0xCBF29CE484222325 and T.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert T.deflated(b"x" * 500) and T.deflated(b"q") is None


def test_correlation(spark):
    flat, ramp = F.array(*[F.lit(5)] * 4), F.array(*[F.lit(x) for x in (1, 2, 3, 4)])
    down = F.array(*[F.lit(x) for x in (4, 3, 2, 1)])
    got = one(spark, gates.correlation(flat, flat), gates.correlation(flat, ramp), gates.correlation(ramp, ramp), gates.correlation(ramp, down), gates.correlation(ramp, F.array(F.lit(1))))
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == pytest.approx(1) and got[3] == pytest.approx(-1) and got[4] is None


def on_vectors(spark, folder, name, vectors):
    """Rows of a query and of its SQL over these vectors, the other tables being the smallest ones."""
    for t in TABLES:
        if t != "embeddings":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors}).to_parquet(folder / "embeddings.parquet", schema=schema)
    got = registry.queries()[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = con.sql(registry.oracle_sql()[name]).select(*got.columns).fetchall()
    return [sorted(tuple(map(plain, r)) for r in d) for d in (got.collect(), want)]


@pytest.mark.parametrize("name", ["box_average", "page_correlation", "integrity"])
def test_pixels_are_of_single_precision(spark, tmp_path, name):
    """F1: single values at and beside the edge of each pixel value give the pixels of the SQL, which stays in single precision."""
    at = (np.arange(-1, 257) / 127.5 - 1).astype(np.float32)
    values = np.concatenate([at, np.nextafter(at, np.float32(-9)), np.nextafter(at, np.float32(9))])
    got, want = on_vectors(spark, tmp_path, name, np.random.RandomState(1).choice(values, (400, 64)).tolist())
    assert len(got) >= 50 and got == want


def test_box_average_of_odd_vectors(spark, tmp_path):
    """blocks without all their pixels have no mean; missing values are black, infinite ones and no numbers at the ends."""
    odd = [None, [], [0.5], [0.5] * 63, [0.25] * 70, [None] * 64, [math.inf, -math.inf, math.nan, -0.0] * 16]
    got, want = on_vectors(spark, tmp_path, "box_average", odd)
    assert len(got) == len(odd) and got == want


def test_verdict_order(spark):
    b = F.lit
    v = lambda o, p, bl, r, h: gates.verdict(b(o), b(p), b(3), b(bl), b(r), b(True), b(h))
    got = one(spark, v(False, 1, True, 0.1, False), v(True, 1, True, 0.1, False), v(True, 3, True, 0.1, False), v(True, 3, False, 0.1, False), v(True, 3, False, 0.9, False), v(True, 3, False, 0.9, True))
    assert list(got) == ["cannotReopen", "pageCountMismatch", "blankPage", "pageDiverged", "textVanished", None]


def test_declines_first_reason(spark):
    base = dict(bpc=8, is_stencil=False, flt="dct", components=3, has_decode=False, has_colour_key=False, mask_w=None, mask_matte=False, mask_decode=False)
    cases = [({}, None), ({"bpc": 1, "flt": "jbig2"}, "bilevel"), ({"flt": "jbig2", "components": 0}, "undecodableFilter"), ({"components": 0, "has_decode": True}, "unresolvableColorSpace"), ({"has_decode": True, "has_colour_key": True}, "decodeArray"), ({"has_colour_key": True}, "colourKeyMask"), ({"mask_w": 3, "mask_matte": True, "mask_decode": True}, "matte"), ({"mask_matte": True}, None), ({"mask_w": 3, "mask_decode": True}, "maskUndecodable")]
    schema = "i int, bpc int, is_stencil boolean, flt string, components int, has_decode boolean, has_colour_key boolean, mask_w int, mask_matte boolean, mask_decode boolean"
    d = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r.r for r in d.select("i", inventory.decline_reason().alias("r")).orderBy("i").collect()] == [w for _, w in cases]


def follow(samples, target, too_big, fits, current):
    aim = target * 0.92
    if len(samples) >= 2:
        (a1, b1), (a2, b2) = samples[-2:]
        if abs(a2 - a1) > 0.001 and abs(math.log(b2) - math.log(b1)) > 0.001:
            x = a2 + (math.log(aim) - math.log(b2)) / ((math.log(b2) - math.log(b1)) / (a2 - a1))
        else:
            x = a2 + (0.08 if b2 > target else -0.08)
    elif samples:
        x = samples[-1][0] + max(-0.5, min(0.5, math.log(samples[-1][1] / aim) * 0.35))
    else:
        x = current + 0.08
    if too_big < fits:
        x = min(max(x, too_big + 0.02), fits - 0.02)
    x = min(max(x, 0), 1)
    if abs(x - current) < 0.08:
        s = current + (0.08 if x >= current else -0.08)
        x = min(max(s, too_big), fits) if too_big < fits else s
    return min(max(x, 0), 1)


def solve(target, start, top, floor, lossless, non_image):
    a, recode, samples, lo, hi, best, least = start, lossless is None, [], 0.0, 1.0, None, None
    for k in range(1, 5):
        got = math.floor(top * (floor / top) ** a) if recode else lossless
        ok = got <= target
        best = max(best or got, got) if ok else best
        least = got if least is None else min(least, got)
        if (ok and not recode) or (ok and got / target >= 0.8) or non_image >= target or k == 4:
            break
        if recode:
            samples.append((a, got))
            lo, hi = (lo, min(hi, a)) if ok else (max(lo, a), hi)
            if a >= 0.999 and not ok:
                break
        a, recode = (1.0 if k == 3 and best is None else follow(samples, target, lo, hi, a)), True
    return k, best if best is not None else least, "met" if best is not None else "bestEffort"


def test_target_search_equals_loop(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(400):
        top = int(rng.randint(200_000, 5_000_000))
        floor = int(top * rng.uniform(0.05, 0.9))
        rows.append((i, int(top * rng.uniform(0.03, 1.1)), float(rng.choice([0.4857, 0.703, 1.0])), top, floor, int(top * 1.05) if rng.rand() < 0.5 else None, int(top * rng.uniform(0, 0.3))))
    d = spark.createDataFrame(rows, "doc_id long, target long, start double, top long, floor long, lossless long, non_image long")
    got = {r.doc_id: (r.passes, r.bytes, r.outcome) for r in estimate.search(d).collect()}
    wrong = [(r, got[r[0]], solve(*r[1:])) for r in rows if got[r[0]] != solve(*r[1:])]
    assert not wrong, (len(wrong), wrong[:3])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_decisions_of_a_deck(spark):
    """Eight slides of a banner stored eight times and a picture of their own: 16 placements, 9 distinct, 7 references."""
    from folioscope.operators import decisions

    def usage(slide, obj, content, w, **more):
        row = {"doc_id": 1, "page_index": slide, "scan_order": 10 * slide + obj % 2, "object_id": obj, "content_id": content, "pixel_w": w, "pixel_h": 1000, "bpc": 8, "components": 3, "flt": "flate", "raw_len": 400_000 + w,
               "drawn_w": 200.0, "drawn_h": 100.0, "mask_w": None, "mask_h": None, "mask_len": None, "mask_matte": False, "mask_decode": False, "has_colour_key": False, "has_decode": False, "is_stencil": False, "page_w": 612.0, "page_h": 792.0}
        return row | more

    rows = [usage(k, 2 * k, 500, 1200) for k in range(8)] + [usage(k, 2 * k + 1, k, 1600 + k) for k in range(5)]
    rows += [usage(5, 11, 5, 1605, has_decode=True), usage(6, 13, 6, 1606, flt="dct", raw_len=300), usage(7, 15, 7, 1607, mask_w=800, mask_h=500, mask_len=9000)]
    schema = "doc_id long, page_index long, scan_order long, object_id long, content_id long, pixel_w long, pixel_h long, bpc int, components int, flt string, raw_len long, drawn_w double, drawn_h double, mask_w int, mask_h int, mask_len long, mask_matte boolean, mask_decode boolean, has_colour_key boolean, has_decode boolean, is_stencil boolean, page_w double, page_h double"
    used = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    objects = spark.createDataFrame([(1, r["object_id"]) for r in rows] + [(1, 99)], "doc_id long, object_id long")
    pages = spark.createDataFrame([(1, k, 484704.0, 2, 1, 0.1, 5) for k in range(8)], "doc_id long, page_index long, page_area double, image_count long, image_bytes long, max_coverage double, text_ops int")
    profiles = spark.createDataFrame([("lossless", 300.0, 0.85, False, False), ("small", 110.0, 0.5, False, True)], "profile_id string, target_dpi double, jpeg_quality double, gray_scans boolean, recodes boolean")
    got = {r.object_id: r.decision for r in decisions.decided(used, objects, pages, profiles).collect()}
    assert got == {0: "recoded", **{2 * k: "deduplicated" for k in range(1, 8)}, **{2 * k + 1: "recoded" for k in range(5)}, 11: "declined:decodeArray", 13: "noSmaller", 15: "recodedWithMask", 99: "declined:neverDrawn"}
    documents = spark.createDataFrame([(1, 20, 17, False)], "doc_id long, raw_objects long, resolved_objects long, is_locked boolean")
    r = decisions.savings(decisions.decided(used, objects, pages, profiles), documents).first()
    assert (r.recoded, r.masks, r.deduplicated, r.declined, r.declined_bytes) == (7, 1, 7, 2, 401_605) and r.dedup_bytes == 7 * 401_200 and r.warnings == "lost 3 of 20; skipped 1"


def test_nearest_ancestor(spark):
    from folioscope.plans.queries import nearest

    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("x", "y"), ("y", "x")], "child string, parent string")
    has = spark.createDataFrame([("n3", "three"), ("n6", "six")], "node string, v string")
    leaves = spark.createDataFrame([(0, "n0"), (1, "n3"), (2, "n4"), (3, "x"), (4, "n0")], "leaf int, node string")
    assert sorted(map(tuple, nearest(leaves, edges, has, 8).collect())) == [(0, "three"), (1, "three"), (2, "six"), (4, "three")]


def test_gate_outcomes(spark):
    """Each failure in its order; the first failing page decides, and pages behind it don't count."""
    from folioscope.operators import decisions

    ramp, down, flat = list(range(16)), list(range(16, 0, -1)), [7] * 16
    own = {0: [(ramp, ramp)] * 3, 1: [(ramp, ramp), (ramp, down), (ramp, flat)], 2: [(ramp, flat), (ramp, down)], 3: [(ramp, ramp)], 4: [(ramp, ramp)], 5: [(ramp, ramp)]}
    pages = spark.createDataFrame([(d, k, a, b) for d, p in own.items() for k, (a, b) in enumerate(p)], "doc_id long, page_index long, source array<long>, produced array<long>")
    documents = spark.createDataFrame([(d, d != 3, len(p) - (d == 4), len(p), True, d != 5) for d, p in own.items()], "doc_id long, opens boolean, pages long, expected long, had_text boolean, has_text boolean")
    got = {r.doc_id: (r.failure, r.failed_page, round(r.worst, 6)) for r in decisions.checked(pages, documents).collect()}
    assert got == {0: (None, None, 0.0), 1: ("pageDiverged", 1, 2.0), 2: ("blankPage", 0, 0.0), 3: ("cannotReopen", None, 0.0), 4: ("pageCountMismatch", None, 0.0), 5: ("textVanished", None, 0.0)}


def test_page_classes(spark):
    """Text without images, a full-bleed scan, a scan with text, a picture on a page."""
    from folioscope.operators import inventory

    rows = [(0, 0.0, 30), (1, 0.97, 0), (1, 0.97, 4), (1, 0.3, 0)]
    got = spark.createDataFrame(rows, "image_count int, max_coverage double, text_ops int").select(inventory.page_class().alias("c")).collect()
    assert [r.c for r in got] == ["vectorOnly", "scanLike", "mixed", "mixed"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_usage_is_dealt_once(spark, monkeypatch):
    """The Spark form of image_usage has the rows of the SQL, deals and sorts plain line items, and identities need no other shuffle."""
    from folioscope.operators import inventory
    from folioscope.sources import adapters

    monkeypatch.setattr(adapters, "SPREAD_ROWS", 2000)
    spark.conf.unset("folioscope.usage_parts")
    usage = adapters.view(spark, SF, "image_usage")
    want = spark.sql(adapters.with_views("SELECT * FROM image_usage"))
    assert usage.columns == want.columns and usage.exceptAll(want).isEmpty() and want.exceptAll(usage).isEmpty()
    dealt = [x for x in plan_of(inventory.storage(usage, adapters.view(spark, SF, "document"))).splitlines() if " Exchange " in x]
    spark.conf.unset("folioscope.usage_parts")
    assert dealt and all("hashpartitioning(l_suppkey" in x for x in dealt), dealt
    behind = plan_of(usage).split("Window", 1)[1]
    assert "pixel_w" not in behind and "flt" not in behind


def test_usage_partitions_grow(spark, monkeypatch):
    """So many partitions that each has a bounded number of line items on average."""
    from folioscope.sources import adapters

    adapters.register(spark, SF)
    n = spark.table("lineitem").count()
    monkeypatch.setattr(adapters, "SPREAD_ROWS", 50)
    spark.conf.unset("folioscope.usage_parts")
    assert adapters.usage_parts(spark, SF) >= n / 50
    assert adapters.view(spark, SF, "page").rdd.getNumPartitions() > 0
    spark.conf.unset("folioscope.usage_parts")


def test_tallies_equal_decisions(spark):
    """Objects summed by identity say what single objects say, also where draws of an object differ and rows are null."""
    from folioscope.operators import decisions
    from folioscope.sources import adapters

    usage, objects, pages, profiles = [adapters.view(spark, SF, n) for n in ("image_usage", "object", "page", "profile")]
    # some draws of an object have another object's size or content
    odd = usage.withColumn("raw_len", F.when(F.col("scan_order") % 7 == 0, F.lit(5000).cast("long")).otherwise(F.col("raw_len"))).withColumn("object_id", F.col("object_id") % 40).withColumn("flt", F.when(F.col("scan_order") % 11 != 0, F.col("flt")))
    stored = odd.select("doc_id", "object_id").distinct().union(objects.where("object_id >= 1000000000"))
    each, tally = decisions.decided(odd, stored, pages, profiles).cache(), decisions.tallied(odd, stored, pages, profiles).cache()
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    by = lambda d: d.groupBy("doc_id", "profile_id", "decision").agg(F.sum("objects").alias("n"), F.sum("own_len").alias("b"))
    assert each.where("decision = 'deduplicated'").count() > 0 and rows(by(each)) == rows(by(tally))
    assert rows(decisions.declines_by_reason(each)) == rows(decisions.declines_by_reason(tally))
    documents = adapters.view(spark, SF, "document")
    assert rows(decisions.savings(each, documents)) == rows(decisions.savings(tally, documents))


def test_sizes_take_one_pass(spark, monkeypatch):
    """Each of line items, documents and pages is dealt once, and draws are sorted once for each window."""
    from folioscope.sources import adapters

    monkeypatch.setattr(adapters, "SPREAD_ROWS", 2000)
    for name in ("inventory_rollup", "estimates", "prediction_accuracy", "target_search"):
        spark.conf.unset("folioscope.usage_parts")
        plan = plan_of(registry.queries()[name](spark, SF)).splitlines()
        spark.conf.unset("folioscope.usage_parts")
        dealt, windows = [x for x in plan if "hashpartitioning(l_suppkey" in x], [x for x in plan if "Window [" in x and "l_suppkey" in x]
        assert len(dealt) == 3 and len(windows) == 1, (name, len(dealt), len(windows))


def test_images_add_up(spark):
    """Sums over distinct images against loops, where draws of an object differ and objects, keys and identities are null."""
    from folioscope.sources import adapters

    usage = adapters.view(spark, SF, "image_usage")
    k = F.col("scan_order")
    odd = usage.withColumn("raw_len", F.when(k % 7 == 0, F.lit(5000).cast("long")).otherwise(F.col("raw_len"))).withColumn("object_id", F.when(k % 13 != 0, F.col("object_id") % 40)).withColumn("flt", F.when(k % 11 != 0, F.col("flt")))
    got = {r.doc_id: tuple(r)[1:] for r in inventory.images(odd).groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in inventory.SUMS]).collect()}
    want = {}
    for doc, d in inventory.identified(inventory.described(odd)).toPandas().groupby("doc_id"):
        d = d.sort_values("scan_order")
        objects = d.fillna({"object_id": -1}).groupby("object_id").total_len.max().sum()
        first, largest = d.groupby("identity").head(1), d.assign(area=d.drawn_w * d.drawn_h).sort_values(["area", "scan_order"], ascending=[False, True]).groupby("identity").head(1)
        contested = (d.fillna({"flt": "-"}).groupby(inventory.KEY).object_id.nunique() > 1).sum()
        want[doc] = (len(d), objects, first.total_len.sum(), len(first), largest[largest.recodable].total_len.sum(), contested)
    assert got == want and len(got) > 1


def test_images_on_scans_give_way(spark):
    """Of three images the one on a scanned page counts as its raster; an unnumbered page hides no image, but counts as a raster itself."""
    from folioscope.sources import adapters

    usage = adapters.view(spark, SF, "image_usage").where("doc_id = 1").orderBy("scan_order").limit(1)
    used = usage.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumns({"page_index": F.when(F.col("k") < 2, F.col("k").cast("long")), "object_id": F.col("k"), "content_id": F.col("k"), "scan_order": F.col("k").cast("long"), "raw_len": F.lit(10**9) + F.col("k"), "pixel_w": F.lit(1000), "pixel_h": F.lit(1000), "drawn_w": F.lit(720.0), "flt": F.lit("flate"), "bpc": F.lit(8), "components": F.lit(3), "has_decode": F.lit(False), "has_colour_key": F.lit(False), "is_stencil": F.lit(False)}).withColumns({"mask_w": F.lit(100), "mask_h": F.lit(80), "mask_len": F.lit(0).cast("long"), "mask_matte": F.lit(False), "mask_decode": F.lit(False)}).drop("k")
    pages = spark.createDataFrame([(1, 0, 5184.0, 1, 0.9, 0), (1, 1, 5184.0, 1, 0.1, 0), (1, None, 5184.0, 1, 0.9, 0), (2, 0, 5184.0, 1, 0.9, 0)], "doc_id long, page_index long, page_area double, image_count long, max_coverage double, text_ops int")
    documents = spark.createDataFrame([(1, 4 * 10**9), (2, 100)], "doc_id long, byte_size long")
    profiles = spark.createDataFrame([("p", 100.0, 0.5, False, True)], "profile_id string, target_dpi double, jpeg_quality double, gray_scans boolean, recodes boolean")
    got = estimate.sized(used, pages, documents, profiles).select("doc_id", "predicted", "scan_pages", "distinct_images").collect()
    image, raster = math.floor(1000 * 1000 * (0.14 + 2.4 * 0.5) / 8) + math.floor(100 * 80 * 0.35 / 8), math.floor(10_000 * (0.14 + 2.4 * 0.5) * 0.65 / 8)
    assert [tuple(r) for r in got] == [(1, 4 * 10**9 - 3 * 10**9 - 3 + 2 * image + 2 * raster + 60 * 3, 2, 3)]

"""The library's queries over the star-schema views, each with an SQL statement that says the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decisions, estimate, gates, inventory
from ..sources.adapters import register, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REASON = """CASE WHEN bpc = 1 OR is_stencil THEN 'bilevel' WHEN flt IN ('ccitt', 'jbig2', 'other') THEN 'undecodableFilter'
  WHEN components < 1 THEN 'unresolvableColorSpace' WHEN has_decode THEN 'decodeArray' WHEN has_colour_key THEN 'colourKeyMask'
  WHEN mask_w IS NOT NULL AND mask_matte THEN 'matte' WHEN mask_w IS NOT NULL AND mask_decode THEN 'maskUndecodable' END"""
#: Usages with an identity that needs no hash: content for contested keys, else the key.
NAMED = f"""SELECT u.*, raw_len + coalesce(mask_len, 0) AS total_len, {REASON} AS reason,
  CASE WHEN k.objects > 1 THEN 'c' || u.content_id || '/' || components || '/' || coalesce(CAST(mask_w AS VARCHAR), '-')
       ELSE 'k' || u.pixel_w || '/' || u.pixel_h || '/' || u.bpc || '/' || u.raw_len || '/' || u.flt END AS identity
  FROM image_usage u JOIN (SELECT doc_id, pixel_w, pixel_h, bpc, raw_len, flt, count(DISTINCT object_id) AS objects FROM image_usage GROUP BY ALL) k
  USING (doc_id, pixel_w, pixel_h, bpc, raw_len, flt)"""
CANONICAL = "SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY doc_id, identity ORDER BY drawn_w * drawn_h DESC, scan_order) = 1"
STORAGE = """SELECT doc_id, byte_size, placements, distinct_images, CAST(least(o, byte_size) AS BIGINT) AS object_bytes, CAST(least(u, byte_size) AS BIGINT) AS unique_bytes FROM document
  JOIN (SELECT doc_id, sum(b) AS o, sum(n) AS placements FROM (SELECT doc_id, object_id, max(raw_len + coalesce(mask_len, 0)) AS b, count(*) AS n FROM image_usage GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
  JOIN (SELECT doc_id, sum(total_len) AS u, count(*) AS distinct_images FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY doc_id, identity ORDER BY scan_order) = 1) GROUP BY doc_id) USING (doc_id)"""
SCANS = "SELECT * FROM page WHERE image_count > 0 AND max_coverage >= 0.85 AND text_ops = 0"
DPI = "CASE WHEN drawn_w <= 0.01 THEN 0 ELSE pixel_w / (drawn_w / 72) END"
ESTIMATES = f"""SELECT s.doc_id, p.profile_id, CASE WHEN NOT p.recodes THEN greatest(0, byte_size - object_bytes) + unique_bytes + 60 * distinct_images
  ELSE greatest(0, byte_size - object_bytes) + coalesce(r.b, 0) + coalesce(i.b, 0) + 60 * distinct_images END AS predicted
  FROM store s CROSS JOIN profile p
  LEFT JOIN (SELECT doc_id, profile_id, sum(CAST(floor(page_area / 5184 * target_dpi * target_dpi * (0.14 + 2.4 * jpeg_quality) * 0.65 * CASE WHEN gray_scans THEN 0.7 ELSE 1 END / 8) AS BIGINT)) AS b FROM scans, profile GROUP BY ALL) r ON r.doc_id = s.doc_id AND r.profile_id = p.profile_id
  LEFT JOIN (SELECT doc_id, profile_id, sum(CASE WHEN reason IS NOT NULL THEN total_len ELSE least(total_len, CAST(floor(px * (0.14 + 2.4 * jpeg_quality) / 8) AS BIGINT) + coalesce(CAST(floor(least(px, mask_w * mask_h * f * f) * 0.35 / 8) AS BIGINT), 0)) END) AS b
    FROM (SELECT *, pixel_w * pixel_h * f * f AS px FROM (SELECT c.*, p.*, CASE WHEN {DPI} <= 1 THEN 1.0 ELSE least(1.0, target_dpi / ({DPI})) END AS f
      FROM canonical c CROSS JOIN profile p WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.doc_id = c.doc_id AND s.page_index = c.page_index))) GROUP BY ALL) i ON i.doc_id = s.doc_id AND i.profile_id = p.profile_id"""
CTES = [("named", NAMED), ("canonical", CANONICAL), ("store", STORAGE), ("scans", SCANS), ("estimate", ESTIMATES)]


def sql(body: str, upto: int = 5) -> str:
    return with_views(body, *CTES[:upto])


def parts(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


@query(sql("""SELECT doc_id, byte_size, CAST(placements AS BIGINT) AS placements, distinct_images, object_bytes, unique_bytes, greatest(0, byte_size - object_bytes) AS non_image_bytes,
  greatest(0, object_bytes - unique_bytes) AS duplicate_bytes, round(object_bytes / byte_size, 6) AS image_fraction, round(greatest(0, object_bytes - unique_bytes) / byte_size, 6) AS duplicate_fraction,
  object_bytes / byte_size >= 0.2 AS worth_compressing, greatest(0, object_bytes - unique_bytes) / byte_size >= 0.25 AS worth_deduplicating FROM store""", 3))
def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A10, A19, F4, F5, J4, P5, P6, U2, W2."""
    d = inventory.storage(*parts(spark, sf_dir, "image_usage", "document"))
    return d.withColumns({k: F.round(k, 6) for k in ("image_fraction", "duplicate_fraction")})


@query(sql("SELECT doc_id, reason, count(*) AS images, CAST(sum(total_len) AS BIGINT) AS bytes FROM canonical WHERE reason IS NOT NULL GROUP BY ALL", 2))
def declines(spark, sf_dir):
    """A5, P1, P2, W1."""
    return inventory.declines(view(spark, sf_dir, "image_usage"))


@query(sql("SELECT doc_id, CAST(sum(CASE WHEN reason IS NULL THEN total_len ELSE 0 END) AS BIGINT) AS addressable_bytes FROM canonical GROUP BY doc_id", 2))
def addressable(spark, sf_dir):
    """A3, A6."""
    return inventory.addressable(view(spark, sf_dir, "image_usage"))


@query(with_views("""SELECT doc_id, pixel_w, pixel_h, bpc, raw_len, flt, count(DISTINCT object_id) AS objects FROM image_usage GROUP BY ALL HAVING count(DISTINCT object_id) > 1"""))
def contested_keys(spark, sf_dir):
    """A10."""
    return inventory.contested_keys(view(spark, sf_dir, "image_usage"))


@query(with_views(f"""SELECT doc_id, scan_order, round({DPI}, 6) AS dpi, round(drawn_w * drawn_h / (page_w * page_h), 9) AS coverage,
  raw_len + coalesce(mask_len, 0) AS total_len, mask_w IS NOT NULL OR has_colour_key AS has_alpha, ({REASON}) IS NULL AS recodable FROM image_usage"""))
def usage_facts(spark, sf_dir):
    """F1, F2, F3, P2, P3."""
    d = inventory.described(view(spark, sf_dir, "image_usage"))
    return d.select("doc_id", "scan_order", F.round("dpi", 6).alias("dpi"), F.round("coverage", 9).alias("coverage"), "total_len", "has_alpha", "recodable")


@query(with_views("""SELECT doc_id, CAST(sum(CASE WHEN image_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS vector_only, CAST(sum(CASE WHEN image_count > 0 AND max_coverage >= 0.85 AND text_ops = 0 THEN 1 ELSE 0 END) AS BIGINT) AS scan_like,
  CAST(sum(CASE WHEN image_count > 0 AND NOT (max_coverage >= 0.85 AND text_ops = 0) THEN 1 ELSE 0 END) AS BIGINT) AS mixed, bool_or(text_ops > 0) AS has_text FROM page GROUP BY doc_id"""))
def page_mix(spark, sf_dir):
    """A4, A7, A8, P4."""
    d = estimate.page_classes(view(spark, sf_dir, "page"))
    count = lambda k: F.sum(F.when(F.col("page_class") == k, 1).otherwise(0))
    return d.groupBy("doc_id").agg(count("vectorOnly").alias("vector_only"), count("scanLike").alias("scan_like"), count("mixed").alias("mixed"), F.bool_or(F.col("text_ops") > 0).alias("has_text"))


@query(with_views("""SELECT doc_id, raw_objects, resolved_objects, greatest(0, raw_objects - resolved_objects) AS unresolved,
  CASE WHEN is_locked THEN 'locked' WHEN raw_objects > 0 AND raw_objects - resolved_objects >= 3 AND (raw_objects - resolved_objects) > 0.25 * raw_objects THEN 'objectsLost' END AS refusal FROM document"""))
def object_loss(spark, sf_dir):
    """J7, P7, P8, U3."""
    return inventory.object_loss(view(spark, sf_dir, "document"))


@query(with_views("""SELECT doc_id, b AS largest_pixels, 60000000 + 4 * s AS estimated_peak, byte_size <= 30000000 AND b <= 12000000 AND 60000000 + 4 * s < 70000000 AS admitted
  FROM document JOIN (SELECT doc_id, max(CAST(pixel_w AS BIGINT) * pixel_h) AS b, max(CAST(pixel_w AS BIGINT) * pixel_h * greatest(1, components)) AS s FROM image_usage GROUP BY doc_id) USING (doc_id)"""))
def admission(spark, sf_dir):
    """A9, P10, T2."""
    return inventory.admission(*parts(spark, sf_dir, "image_usage", "document"), available=70_000_000)


@query(sql("SELECT doc_id, profile_id, CAST(predicted AS BIGINT) AS predicted FROM estimate"))
def estimates(spark, sf_dir):
    """F10-F14, G10, J3, J9."""
    return estimate.estimates(*parts(spark, sf_dir, "image_usage", "page", "document", "profile"))


@query(sql("""SELECT doc_id, object_bytes, unique_bytes, distinct_images, addressable_bytes, coalesce(contested, 0) AS contested, coalesce(scan_pages, 0) AS scan_pages, CAST(predicted AS BIGINT) AS predicted_send_it
  FROM store JOIN (SELECT doc_id, CAST(sum(CASE WHEN reason IS NULL THEN total_len ELSE 0 END) AS BIGINT) AS addressable_bytes FROM canonical GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS contested FROM (SELECT doc_id, pixel_w FROM image_usage GROUP BY doc_id, pixel_w, pixel_h, bpc, raw_len, flt HAVING count(DISTINCT object_id) > 1) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS scan_pages FROM scans GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, predicted FROM estimate WHERE profile_id = 'sendIt') USING (doc_id)"""))
def inventory_rollup(spark, sf_dir):
    """Flagship: one row for each document with what it stores and what it would become."""
    usage, pages, documents, profiles = parts(spark, sf_dir, "image_usage", "page", "document", "profile")
    d = estimate.sized(usage, pages, documents, profiles.where("profile_id = 'sendIt'"))
    named = {"addressable_bytes": "raw_addressable_bytes", "contested": "contested_keys", "predicted_send_it": "predicted"}
    return d.select("doc_id", "object_bytes", "unique_bytes", "distinct_images", *[F.col(named.get(k, k)).alias(k) for k in ("addressable_bytes", "contested", "scan_pages", "predicted_send_it")])


@query(sql("""SELECT profile_id, count(*) AS documents, round(avg(e), 6) AS mean_error, round(list_sort(list(e))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS upper_median, CAST(sum(CASE WHEN e <= 0.15 THEN 1 ELSE 0 END) AS BIGINT) AS within
  FROM (SELECT profile_id, abs(predicted - a) / a AS e FROM estimate JOIN (SELECT doc_id, byte_size * (40 + doc_id % 50) / 100.0 AS a FROM document) USING (doc_id)) GROUP BY profile_id"""))
def prediction_accuracy(spark, sf_dir):
    """The upper median, not the mean of the middle two. Achieved sizes are stand-ins."""
    usage, pages, documents, profiles = parts(spark, sf_dir, "image_usage", "page", "document", "profile")
    actual = (F.col("byte_size") * (40 + F.col("doc_id") % 50) / 100.0).alias("a")
    e = estimate.sized(usage, pages, documents, profiles).select("doc_id", "profile_id", "predicted", actual).withColumn("e", F.abs(F.col("predicted") - F.col("a")) / F.col("a"))
    w = W.partitionBy("profile_id").orderBy("e", "doc_id")
    ranked = e.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("profile_id")))
    return ranked.groupBy("profile_id").agg(F.count("*").alias("documents"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("e"))), 6).alias("upper_median"), F.sum(F.when(F.col("e") <= 0.15, 1).otherwise(0)).alias("within"))


@query()
def target_search(spark, sf_dir):
    """Passes, bytes and outcome for two targets. Tested against a loop in Python."""
    usage, pages, documents, profiles = parts(spark, sf_dir, "image_usage", "page", "document", "profile")
    sizes = estimate.sized(usage, pages, documents, profiles).groupBy("doc_id", "non_image_bytes", "duplicate_bytes")
    d = sizes.pivot("profile_id", ["lossless", "sendIt", "small", "tiny"]).agg(F.first("predicted"))
    d = d.withColumn("target", F.explode(F.array(F.lit(2_000_000), F.lit(500_000)).cast("array<long>")))
    start = F.when(F.col("sendIt") <= F.col("target"), estimate.aggression(F.lit(150.0))).when(F.col("small") <= F.col("target"), estimate.aggression(F.lit(110.0))).otherwise(1.0)
    return estimate.search(d.select("doc_id", "target", start.alias("start"), F.greatest("lossless", "sendIt").alias("top"), F.least("tiny", "small").alias("floor"), F.when(F.col("duplicate_bytes") > 0, F.col("lossless")).alias("lossless"), F.col("non_image_bytes").alias("non_image")))


@query(sql("""SELECT doc_id, scan_order, object_id, total_len FROM canonical QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total_len DESC, scan_order) <= 5""", 2))
def top_images(spark, sf_dir):
    """The five largest distinct images of each document, however often each is drawn."""
    images = inventory.canonical(inventory.identified(inventory.described(view(spark, sf_dir, "image_usage"))))
    w = W.partitionBy("doc_id").orderBy(F.desc("total_len"), "scan_order")
    return images.withColumn("k", F.row_number().over(w)).where("k <= 5").select("doc_id", "scan_order", "object_id", "total_len")


@query(with_views("""SELECT file_id, pass, bytes, coalesce(bytes - lag(bytes) OVER w, 0) AS delta, max(fraction) OVER w AS progress,
  max(CASE WHEN bytes > 500000 THEN fraction END) OVER w AS too_big, min(CASE WHEN bytes <= 500000 THEN fraction END) OVER w AS fits FROM run WINDOW w AS (PARTITION BY file_id ORDER BY pass)"""))
def run_windows(spark, sf_dir):
    """Change since the last run, progress that never goes back, the running bracket."""
    w = W.partitionBy("file_id").orderBy("pass")
    c = F.col
    return view(spark, sf_dir, "run").select("file_id", "pass", "bytes", F.coalesce(c("bytes") - F.lag("bytes").over(w), F.lit(0)).alias("delta"), F.max("fraction").over(w).alias("progress"), F.max(F.when(c("bytes") > 500000, c("fraction"))).over(w).alias("too_big"), F.min(F.when(c("bytes") <= 500000, c("fraction"))).over(w).alias("fits"))


@query(with_views("""SELECT file_id, pass, bytes FROM run QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY bytes > 500000, CASE WHEN bytes <= 500000 THEN -bytes ELSE bytes END, pass) = 1"""))
def best_pass(spark, sf_dir):
    """The largest that fits, else the smallest; the earliest of equals."""
    w = W.partitionBy("file_id").orderBy(F.col("bytes") > 500000, F.when(F.col("bytes") <= 500000, -F.col("bytes")).otherwise(F.col("bytes")), "pass")
    return view(spark, sf_dir, "run").withColumn("k", F.row_number().over(w)).where("k = 1").select("file_id", "pass", "bytes")


@query(with_views("""SELECT file_id, min_by(bytes, pass) AS first_bytes, max_by(bytes, pass) AS last_bytes, max(bytes) AS peak_bytes, count(*) AS runs, max(bytes) - min_by(bytes, pass) < 15000000 AS flat FROM run GROUP BY file_id"""))
def soak_summary(spark, sf_dir):
    """A12, A13, A17."""
    return view(spark, sf_dir, "run").groupBy("file_id").agg(F.min_by("bytes", "pass").alias("first_bytes"), F.max_by("bytes", "pass").alias("last_bytes"), F.max("bytes").alias("peak_bytes"), F.count("*").alias("runs"), (F.max("bytes") - F.min_by("bytes", "pass") < 15_000_000).alias("flat"))


@query(with_views("""SELECT install, greatest(a, b) AS used, greatest(0, 10 - greatest(a, b)) AS remaining, greatest(0, 10 - greatest(a, b)) BETWEEN 1 AND 3 AS mention FROM (SELECT user_id AS install,
  count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id)"""))
def ledger(spark, sf_dir):
    """Two stores, the larger count stands."""
    register(spark, sf_dir)
    e = spark.table("events").groupBy(F.col("user_id").alias("install")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("a"), F.count(F.when(F.col("event_type") == "click", 1)).alias("b"))
    e = e.withColumn("used", F.greatest("a", "b")).withColumn("remaining", F.greatest(F.lit(0), 10 - F.col("used")))
    return e.select("install", "used", "remaining", F.col("remaining").between(1, 3).alias("mention"))


@query("""SELECT n, list_sort(list(DISTINCT i)) AS indices FROM (SELECT n, CASE WHEN n <= 25 THEN k ELSE least(n - 1, CAST(round(k * ((n - 1) / 11.0)) AS BIGINT)) END AS i
  FROM (SELECT DISTINCT 1 + c_custkey % 900 AS n FROM customer) CROSS JOIN (SELECT unnest(range(25)) AS k) WHERE CASE WHEN n <= 25 THEN k < n ELSE k < 12 END) GROUP BY n""")
def sample_pages(spark, sf_dir):
    """Every page of short documents, else twelve evenly spaced with both ends."""
    register(spark, sf_dir)
    n = spark.table("customer").select((1 + F.col("c_custkey") % 900).alias("n")).distinct()
    return n.select("n", gates.sample_indices(F.col("n")).alias("indices"))


THUMBS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(255, greatest(0, (x + 1) * 127.5))) AS BIGINT)) AS pixels FROM embeddings"


@query(f"""WITH t AS ({THUMBS}), p AS (SELECT a.vec_id, a.pixels AS a, b.pixels AS b FROM t a JOIN t b ON b.vec_id = a.vec_id + 1),
  x AS (SELECT vec_id, unnest(a) AS u, unnest(b) AS v FROM p), m AS (SELECT vec_id, count(*) AS n, avg(u) AS mu, avg(v) AS mv FROM x GROUP BY vec_id),
  s AS (SELECT vec_id, any_value(n) AS n, sum((u - mu) * (v - mv)) AS c, sum((u - mu) * (u - mu)) AS va, sum((v - mv) * (v - mv)) AS vb FROM x JOIN m USING (vec_id) GROUP BY vec_id)
  SELECT vec_id, round(CASE WHEN va <= 1e-6 * n AND vb <= 1e-6 * n THEN 1.0 WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE c / (sqrt(va) * sqrt(vb)) END, 6) AS r FROM s""")
def page_correlation(spark, sf_dir):
    """Likeness of two thumbnails."""
    t = gates.thumbnails(spark, sf_dir)
    pairs = t.toDF("vec_id", "a").join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pixels").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(gates.correlation(F.col("a"), F.col("b")), 6).alias("r"))


@query(f"""WITH t AS ({THUMBS}) SELECT vec_id, list_transform(range(16), lambda k: CAST(floor((pixels[(k // 4) * 16 + (k % 4) * 2 + 1] + pixels[(k // 4) * 16 + (k % 4) * 2 + 2]
  + pixels[(k // 4) * 16 + (k % 4) * 2 + 9] + pixels[(k // 4) * 16 + (k % 4) * 2 + 10]) / 4) AS BIGINT)) AS small, list_min(pixels) = list_max(pixels) AS flat FROM t""")
def box_average(spark, sf_dir):
    """8 x 8 to 4 x 4 by truncated block means; whether all pixels are equal."""
    t = gates.thumbnails(spark, sf_dir)
    return t.select("vec_id", gates.box_average(F.col("pixels"), 8, 4).alias("small"), (F.array_min("pixels") == F.array_max("pixels")).alias("flat"))


@query("""SELECT doc_id, first_id, doc_id <> first_id AS duplicate, CASE WHEN doc_id <> first_id THEN octet_length(encode(t)) ELSE 0 END AS saved FROM
  (SELECT doc_id, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents)""")
def stream_dedup(spark, sf_dir):
    """Content-addressed copies; a missing stream is an empty one.

    The scan turns each stream into its digest and length, so only these are shuffled, spread by digest.
    """
    register(spark, sf_dir)
    t = F.coalesce("text", F.lit(""))
    d = spark.table("documents").select("doc_id", F.octet_length(t).cast("long").alias("len"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("identity"))
    d = d.join(d.groupBy("identity").agg(F.min("doc_id").alias("first_id")), "identity")
    same = F.col("doc_id") == F.col("first_id")
    return d.select("doc_id", "first_id", (~same).alias("duplicate"), F.when(same, 0).otherwise(F.col("len")).alias("saved"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<(a|img)[\\s>]')) AS BIGINT) AS markers FROM pages""")
def raw_census(spark, sf_dir):
    """Markers counted in raw bytes, whatever a parser makes of them."""
    register(spark, sf_dir)
    return spark.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?i)<(a|img)[\s>]"), F.lit(0))).cast("long").alias("markers"))


def nearest(leaves: DataFrame, edges: DataFrame, has: DataFrame, most: int = 64) -> DataFrame:
    """(leaf, v): of each leaf (leaf, node) the value (node, v) of its nearest ancestor-or-self node over edges (child, parent).

    Only distinct nodes climb, level by level; the leaves are joined once, at the end.
    """
    at = leaves.select(F.col("node").alias("start"), "node").distinct()
    found = None
    for _ in range(most):
        here = at.join(has, "node").select("start", "v")
        found = here if found is None else found.union(here)
        at = at.join(has, "node", "left_anti").join(edges, at.node == edges.child).select("start", F.col("parent").alias("node"))
        if at.isEmpty():
            break
    return leaves.join(found, leaves.node == found.start).select("leaf", "v")


@query("""SELECT o_orderkey AS leaf, coalesce(CASE WHEN c_acctbal > 0 THEN 'customer' END, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' END, 'region') AS inherited_from
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def inherited(spark, sf_dir):
    """The nearest ancestor that has the attribute, walking parents level by level (at most 64)."""
    register(spark, sf_dir)
    edges = spark.sql("SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
    has = spark.sql("""SELECT 'c' || c_custkey AS node, 'customer' AS v FROM customer WHERE c_acctbal > 0 UNION ALL
      SELECT 'n' || n_nationkey, 'nation' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region""")
    leaves = spark.sql("SELECT o_orderkey AS leaf, 'c' || o_custkey AS node FROM orders")
    return nearest(leaves, edges, has).withColumnRenamed("v", "inherited_from")


VERDICTS = f"""SELECT doc_id, identity, profile_id, total_len, produced, CASE WHEN reason IS NOT NULL THEN 'declined:' || reason
    WHEN (f >= 0.999 AND flt = 'dct' AND mask_w IS NULL AND NOT (gray_scans AND scan) AND jpeg_quality >= 0.6) OR produced >= total_len THEN 'noSmaller' WHEN mask_w IS NOT NULL THEN 'recodedWithMask' ELSE 'recoded' END AS verdict
  FROM (SELECT *, CAST(floor(w * h * (0.14 + 2.4 * jpeg_quality) / 8) AS BIGINT) + coalesce(CAST(floor(least(w * h, mask_w * mask_h * f * f) * 0.35 / 8) AS BIGINT), 0) AS produced
    FROM (SELECT *, greatest(1, CAST(round(pixel_w * f) AS BIGINT)) AS w, greatest(1, CAST(round(pixel_h * f) AS BIGINT)) AS h FROM (SELECT c.*, p.*, CASE WHEN {DPI} <= 1 THEN 1.0 ELSE least(1.0, target_dpi / ({DPI})) END AS f,
      EXISTS (SELECT 1 FROM scans s WHERE s.doc_id = c.doc_id AND s.page_index = c.page_index) AS scan FROM canonical c CROSS JOIN profile p WHERE p.recodes)))"""
DECIDED = """SELECT o.doc_id, o.object_id, p.profile_id, d.identity, coalesce(d.own_len, 0) AS own_len, coalesce(v.total_len, 0) AS total_len, v.produced,
    CASE WHEN d.identity IS NULL THEN 'declined:neverDrawn' WHEN v.verdict LIKE 'recoded%' AND d.met > d.first THEN 'deduplicated' ELSE v.verdict END AS decision
  FROM object o CROSS JOIN profile p LEFT JOIN (SELECT doc_id, object_id, identity, own_len, met, min(met) OVER (PARTITION BY doc_id, identity) AS first FROM
    (SELECT doc_id, object_id, min_by(identity, scan_order) AS identity, max(total_len) AS own_len, min(scan_order) AS met FROM named GROUP BY doc_id, object_id)) d ON d.doc_id = o.doc_id AND d.object_id = o.object_id
  LEFT JOIN verdicts v ON v.doc_id = o.doc_id AND v.identity = d.identity AND v.profile_id = p.profile_id WHERE p.recodes"""
DECIDED_CTES = [("named", NAMED), ("canonical", CANONICAL), ("scans", SCANS), ("verdicts", VERDICTS), ("decided", DECIDED)]
ONCE = "coalesce(identity, 'object ' || object_id)"


def tallied(spark, sf_dir):
    return decisions.tallied(*parts(spark, sf_dir, "image_usage", "object", "page", "profile"))


@query(with_views("SELECT doc_id, profile_id, decision, count(*) AS objects, CAST(sum(own_len) AS BIGINT) AS bytes FROM decided GROUP BY ALL", *DECIDED_CTES))
def image_decisions(spark, sf_dir):
    """E1's decisions, E8, F52, J2, P16, P17: what becomes of the stored objects of each document under each recoding profile."""
    return tallied(spark, sf_dir).groupBy("doc_id", "profile_id", "decision").agg(F.sum("objects").alias("objects"), F.sum("own_len").alias("bytes"))


@query(with_views(f"""SELECT doc_id, profile_id, recode_bytes, dedup_bytes, recoded, masks, deduplicated, coalesce(declined, 0) AS declined, coalesce(declined_bytes, 0) AS declined_bytes,
    concat_ws('; ', CASE WHEN raw_objects > resolved_objects THEN 'lost ' || (raw_objects - resolved_objects) || ' of ' || raw_objects END, CASE WHEN skipped > 0 THEN 'skipped ' || skipped END) AS warnings
  FROM (SELECT doc_id, profile_id, CAST(greatest(0, sum(CASE WHEN decision LIKE 'recoded%' THEN total_len - produced ELSE 0 END)) AS BIGINT) AS recode_bytes, CAST(sum(CASE WHEN decision = 'deduplicated' THEN own_len ELSE 0 END) AS BIGINT) AS dedup_bytes,
      count(*) FILTER (decision LIKE 'recoded%') AS recoded, count(*) FILTER (decision = 'recodedWithMask') AS masks, count(*) FILTER (decision = 'deduplicated') AS deduplicated,
      count(*) FILTER (decision LIKE 'declined:%' AND identity IS NOT NULL) AS skipped FROM decided GROUP BY ALL)
  LEFT JOIN (SELECT doc_id, profile_id, count(*) AS declined, CAST(sum(b) AS BIGINT) AS declined_bytes FROM (SELECT doc_id, profile_id, {ONCE} AS i, max(total_len) AS b FROM decided WHERE decision LIKE 'declined:%' GROUP BY ALL) GROUP BY ALL) USING (doc_id, profile_id)
  JOIN document USING (doc_id)""", *DECIDED_CTES))
def savings(spark, sf_dir):
    """Bytes saved by re-encoding and by references, declines once for each image, warnings."""
    return decisions.savings(tallied(spark, sf_dir), view(spark, sf_dir, "document"))


@query(with_views(f"""SELECT doc_id, profile_id, reason, count(*) AS images, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT doc_id, profile_id, split_part(decision, ':', 2) AS reason, {ONCE} AS i, max(total_len) AS b
  FROM decided WHERE decision LIKE 'declined:%' GROUP BY ALL) GROUP BY ALL""", *DECIDED_CTES))
def declines_by_reason(spark, sf_dir):
    """Distinct images that were left alone, by reason."""
    return decisions.declines_by_reason(tallied(spark, sf_dir))


PRODUCED = f"""SELECT a.vec_id // 8 AS doc_id, a.vec_id % 8 AS page_index, a.pixels AS source, CASE WHEN a.vec_id % 29 = 5 THEN list_transform(a.pixels, lambda x: CAST(0 AS BIGINT)) WHEN a.vec_id % 23 = 3 THEN b.pixels ELSE a.pixels END AS produced
  FROM ({THUMBS}) a JOIN ({THUMBS}) b ON b.vec_id = a.vec_id + 1"""


@query(f"""WITH p AS ({PRODUCED}), d AS (SELECT doc_id, doc_id % 17 <> 0 AS opens, count(*) - CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS pages, count(*) AS expected, doc_id % 3 <> 0 AS had_text, doc_id % 6 <> 1 AS has_text FROM p GROUP BY doc_id),
  x AS (SELECT doc_id, page_index, list_min(produced) = list_max(produced) AS blank, unnest(source) AS u, unnest(produced) AS v FROM p JOIN d USING (doc_id) WHERE opens AND pages = expected),
  m AS (SELECT doc_id, page_index, any_value(blank) AS blank, count(*) AS n, avg(u) AS mu, avg(v) AS mv FROM x GROUP BY ALL),
  s AS (SELECT doc_id, page_index, any_value(m.blank) AS blank, any_value(n) AS n, sum((u - mu) * (v - mv)) AS c, sum((u - mu) * (u - mu)) AS va, sum((v - mv) * (v - mv)) AS vb FROM x JOIN m USING (doc_id, page_index) GROUP BY ALL),
  r AS (SELECT *, CASE WHEN va <= 1e-6 * n AND vb <= 1e-6 * n THEN 1.0 WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE c / (sqrt(va) * sqrt(vb)) END AS r FROM s),
  f AS (SELECT doc_id, min(page_index) AS failed_page, min_by(CASE WHEN blank THEN 'blankPage' ELSE 'pageDiverged' END, page_index) AS fault FROM r WHERE blank OR r < 0.75 GROUP BY doc_id),
  w AS (SELECT doc_id, max(CASE WHEN NOT blank THEN 1 - r END) AS worst FROM r LEFT JOIN f USING (doc_id) WHERE failed_page IS NULL OR page_index <= failed_page GROUP BY doc_id),
  v AS (SELECT *, CASE WHEN NOT opens THEN 'cannotReopen' WHEN pages <> expected THEN 'pageCountMismatch' ELSE coalesce(fault, CASE WHEN had_text AND NOT has_text THEN 'textVanished' END) END AS failure FROM d LEFT JOIN f USING (doc_id) LEFT JOIN w USING (doc_id))
  SELECT doc_id, failure, failed_page, round(greatest(0, coalesce(worst, 0)), 6) AS worst, failure IS NULL AS passed FROM v""")
def integrity(spark, sf_dir):
    """The gate over produced documents of eight pages: some don't open, lost a page, have a blank or another page, lost their text."""
    t = gates.thumbnails(spark, sf_dir)
    v = F.col("vec_id")
    pairs = t.toDF("vec_id", "source").join(t.select((v - 1).alias("vec_id"), F.col("pixels").alias("next")), "vec_id")
    made = F.when(v % 29 == 5, F.transform("source", lambda x: F.lit(0).cast("long"))).when(v % 23 == 3, F.col("next")).otherwise(F.col("source"))
    pages = pairs.select(F.floor(v / 8).alias("doc_id"), (v % 8).alias("page_index"), "source", made.alias("produced"))
    k = F.col("doc_id")
    documents = pages.groupBy("doc_id").agg(F.count("*").alias("expected")).select("doc_id", (k % 17 != 0).alias("opens"), (F.col("expected") - F.when(k % 13 == 0, 1).otherwise(0)).alias("pages"), "expected", (k % 3 != 0).alias("had_text"), (k % 6 != 1).alias("has_text"))
    return decisions.checked(pages, documents).withColumn("worst", F.round("worst", 6))

"""Rules on page geometry, numbers, dictionaries, forms, staging and entitlements as queries; the tables stand in for parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.adapters import register

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


def page_transform(x0: Column, y0: Column, w: Column, h: Column, rotation: Column, pixel_w: Column, pixel_h: Column) -> dict[str, Column]:
    """the six numbers (xx, xy, yx, yy, tx, ty) that take a page point to a pixel: off the box's origin, turned, onto the bitmap.

    x goes to xx * x + yx * y + tx, y to xy * x + yy * y + ty. A box without area has the identity.
    """
    turn = F.pmod(rotation, F.lit(360))
    aside = turn.isin(90, 270)
    good = (w > 0) & (h > 0)
    sx = pixel_w / F.when(good, F.when(aside, h).otherwise(w)).otherwise(1.0)
    sy = pixel_h / F.when(good, F.when(aside, w).otherwise(h)).otherwise(1.0)
    cos = F.when(turn == 180, -1.0).when(aside, 0.0).otherwise(1.0)
    sin = F.when(turn == 90, 1.0).when(turn == 270, -1.0).otherwise(0.0)
    right = F.when(turn == 90, h).when(turn == 180, w).otherwise(0.0)
    up = F.when(turn == 180, h).when(turn == 270, w).otherwise(0.0)
    out = {"xx": sx * cos, "xy": sy * sin, "yx": -sx * sin, "yy": sy * cos, "tx": sx * (right - cos * x0 + sin * y0), "ty": sy * (up - sin * x0 - cos * y0)}
    return {k: F.when(good, v).otherwise(1.0 if k in ("xx", "yy") else 0.0) for k, v in out.items()}


@query("""SELECT key, round(CASE WHEN NOT good THEN 1 WHEN r = 0 THEN sx WHEN r = 180 THEN -sx ELSE 0 END, 6) + 0.0 AS xx, round(CASE WHEN NOT good THEN 0 WHEN r = 90 THEN sy WHEN r = 270 THEN -sy ELSE 0 END, 6) + 0.0 AS xy,
  round(CASE WHEN NOT good THEN 0 WHEN r = 90 THEN -sx WHEN r = 270 THEN sx ELSE 0 END, 6) + 0.0 AS yx, round(CASE WHEN NOT good THEN 1 WHEN r = 0 THEN sy WHEN r = 180 THEN -sy ELSE 0 END, 6) + 0.0 AS yy,
  round(CASE WHEN NOT good THEN 0 WHEN r = 0 THEN -sx * x0 WHEN r = 90 THEN sx * (h + y0) WHEN r = 180 THEN sx * (w + x0) ELSE -sx * y0 END, 6) + 0.0 AS tx,
  round(CASE WHEN NOT good THEN 0 WHEN r = 0 THEN -sy * y0 WHEN r = 90 THEN -sy * x0 WHEN r = 180 THEN sy * (h + y0) ELSE sy * (w + x0) END, 6) + 0.0 AS ty
  FROM (SELECT *, w > 0 AND h > 0 AS good, 256 / CASE WHEN NOT (w > 0 AND h > 0) THEN 1.0 WHEN r IN (90, 270) THEN h ELSE w END AS sx, 200 / CASE WHEN NOT (w > 0 AND h > 0) THEN 1.0 WHEN r IN (90, 270) THEN w ELSE h END AS sy
  FROM (SELECT l_orderkey * 10 + l_linenumber AS key, CAST(l_linenumber * 3 - 3 AS DOUBLE) AS x0, CAST(l_suppkey % 5 AS DOUBLE) AS y0, (CAST(l_quantity AS DOUBLE) - 3) * 12 AS w, CAST(l_extendedprice AS DOUBLE) / 100 AS h, ((l_linenumber * 90 - 360) % 360 + 360) % 360 AS r FROM lineitem))""")
def page_transforms(spark, sf_dir):
    """F35."""
    k = F.col("l_linenumber")
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("key"), (k * 3 - 3).cast("double").alias("x0"), (F.col("l_suppkey") % 5).cast("double").alias("y0"), ((F.col("l_quantity").cast("double") - 3) * 12).alias("w"), (F.col("l_extendedprice").cast("double") / 100).alias("h"), (k * 90 - 360).alias("r"))
    m = page_transform(*(F.col(c) for c in ("x0", "y0", "w", "h", "r")), F.lit(256.0), F.lit(200.0))
    return d.select("key", *((F.round(v, 6) + 0.0).alias(n) for n, v in m.items()))


def real_format(d: Column) -> Column:
    """whole numbers without a point, others with six decimals at most, 0 for what isn't finite."""
    finite = ~F.isnan(d) & (F.abs(d) != float("inf"))
    whole = (d == F.round(d)) & (F.abs(d) < 1e15)
    return F.when(~finite, "0").when(whole, F.when(whole, d).otherwise(0.0).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", d), r"\.?0+$", ""))


@query(r"""SELECT key, CASE WHEN NOT isfinite(d) THEN '0' WHEN d = round(d) AND abs(d) < 1e15 THEN CAST(CAST(d AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', d), '\.?0+$', '') END AS shown
  FROM (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_partkey % 11 = 1 THEN CAST('-Infinity' AS DOUBLE) WHEN p_partkey % 5 = 2 THEN CAST(p_size - 20 AS DOUBLE) WHEN p_partkey % 5 = 3 THEN p_size / 4.0 ELSE (p_size - 25) / 7.0 END AS d FROM part)""")
def real_formats(spark, sf_dir):
    """F47."""
    k, z = F.col("p_partkey"), F.col("p_size")
    d = F.when(k % 11 == 0, float("nan")).when(k % 11 == 1, float("-inf")).when(k % 5 == 2, (z - 20).cast("double")).when(k % 5 == 3, z / 4.0).otherwise((z - 25) / 7.0)
    return table(spark, sf_dir, "part").select(k.alias("key"), real_format(d).alias("shown"))


#: Keys that are copied from a catalog and from a page, keys dropped from any dictionary, annotations dropped.
CATALOG_KEYS = ("Outlines", "PageLabels", "Names", "AcroForm", "ViewerPreferences", "PageLayout", "PageMode", "Lang", "OpenAction", "Dests", "MarkInfo")
PAGE_KEYS = ("Contents", "Resources", "MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "Rotate", "Group", "UserUnit", "Tabs")
DROPPED_KEYS = ("Metadata", "Thumb", "PieceInfo", "StructParents", "StructTreeRoot")
DROPPED_ANNOTATIONS = ("FileAttachment", "Sound", "Movie", "RichMedia", "Screen", "3D")
ALL_KEYS = (*CATALOG_KEYS, *PAGE_KEYS, *DROPPED_KEYS, *DROPPED_ANNOTATIONS, "Parent", "Font", "Link", "Widget")
KINDS = ("catalog", "page", "annotation", "other")


def copied(kind: Column, key: Column) -> Column:
    """Whether a dictionary's key is copied (for annotations: whether the subtype stays)."""
    return F.when(kind == "catalog", key.isin(*CATALOG_KEYS)).when(kind == "page", key.isin(*PAGE_KEYS)).when(kind == "annotation", ~key.isin(*DROPPED_ANNOTATIONS)).otherwise(~key.isin(*DROPPED_KEYS))


def listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(f"""SELECT part, kind, count(*) AS keys, string_agg(key, ',' ORDER BY key) AS copied FROM (SELECT p_partkey AS part, [{listed(KINDS)}][p_partkey % 4 + 1] AS kind, k.key FROM part JOIN
  (SELECT unnest([{listed(ALL_KEYS)}]) AS key, unnest(range({len(ALL_KEYS)})) AS i) k ON (p_partkey + i) % 3 = 0)
  WHERE CASE kind WHEN 'catalog' THEN key IN ({listed(CATALOG_KEYS)}) WHEN 'page' THEN key IN ({listed(PAGE_KEYS)}) WHEN 'annotation' THEN key NOT IN ({listed(DROPPED_ANNOTATIONS)}) ELSE key NOT IN ({listed(DROPPED_KEYS)}) END GROUP BY ALL""")
def copied_keys(spark, sf_dir):
    """Allow-lists of catalogs and pages, deny-lists of all else."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), kind.alias("kind"), F.posexplode(F.array(*map(F.lit, ALL_KEYS))).alias("i", "key"))
    kept = entries.where(((F.col("part") + F.col("i")) % 3 == 0) & copied(F.col("kind"), F.col("key")))
    return kept.groupBy("part", "kind").agg(F.count("*").alias("keys"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("copied"))


def walked(roots: DataFrame, nested: DataFrame, depth: int) -> DataFrame:
    """Distinct (doc, form) met from roots over nested (parent, child), fewer than ``depth`` levels down."""
    level = roots.select("doc", "form").distinct()
    met = level
    for _ in range(depth - 1):
        level = level.join(nested, level.form == nested.parent).select("doc", F.col("child").alias("form")).distinct()
        met = met.union(level)
    return met.distinct()


NESTED = "SELECT c_custkey AS parent, c_custkey * 2 AS child FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 50 = 0"


@query(f"""WITH RECURSIVE nested AS ({NESTED}), walk(doc, form, depth) AS (SELECT c_nationkey, c_custkey, 0 FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT doc, child, depth + 1 FROM walk JOIN nested ON parent = form WHERE depth + 1 < 8)
  SELECT doc, count(*) AS reachable FROM (SELECT doc, form * 7 % 500 AS object FROM walk UNION SELECT doc, form * 3 % 500 FROM walk UNION SELECT c_nationkey, c_custkey % 40 FROM customer UNION SELECT c_nationkey, 500 + c_custkey % 9 FROM customer) GROUP BY doc""")
def reachable_objects(spark, sf_dir):
    """Image objects of nested forms down to depth 8, with those drawn and those that are masks, each once."""
    c = table(spark, sf_dir, "customer")
    forms = walked(c.where("c_custkey % 10 = 1").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("form")), spark.sql(NESTED), 8)
    objects = forms.selectExpr("doc", "explode(array(form * 7 % 500, form * 3 % 500)) AS object").union(c.selectExpr("c_nationkey", "c_custkey % 40")).union(c.selectExpr("c_nationkey", "500 + c_custkey % 9"))
    return objects.distinct().groupBy("doc").agg(F.count("*").alias("reachable"))


@query("SELECT c_nationkey AS folder, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS place FROM customer")
def staged_order(spark, sf_dir):
    """Staged files are adopted in the order of their names."""
    w = W.partitionBy("folder").orderBy("name")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_name").alias("name")).withColumn("place", F.row_number().over(w))


@query("""SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase' AND event_id % 5 <> 0 AND event_id % 7 <> 0)""")
def entitled(spark, sf_dir):
    """Customers with a purchase of the product that isn't revoked (every seventh is, every fifth is of another product)."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase' AND event_id % 5 != 0 AND event_id % 7 != 0").select(F.col("user_id").alias("customer"))
    return spark.table("customer").select(F.col("c_custkey").alias("customer")).join(bought, "customer", "left_semi")


#: The kinds of warnings, and those that are shown.
WARNINGS, SHOWN = ("formFieldsPresent", "possibleObjectLoss", "imagesSkipped", "pagesRasterized", "pageFellBackToRaster", "readabilityFloor"), ("formFieldsPresent", "possibleObjectLoss")


@query(f"""SELECT o_orderkey AS run, array_to_string(list_filter([{listed(WARNINGS)}], lambda w: (o_orderkey + length(w)) % 3 = 0 AND w IN ({listed(SHOWN)})), ',') AS shown FROM orders""")
def shown_warnings(spark, sf_dir):
    """Of a run's warnings two kinds are shown."""
    given = F.filter(F.array(*map(F.lit, WARNINGS)), lambda w: (F.col("o_orderkey") + F.length(w)) % 3 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.array_join(F.filter(given, lambda w: w.isin(*SHOWN)), ",").alias("shown"))


@query("""SELECT part, url, CASE WHEN url LIKE 'folioscope://open?%' THEN url_decode(regexp_extract(url, 'name=([^&]*)', 1)) END AS opened FROM
  (SELECT p_partkey AS part, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'folioscope' END || '://open?name=' || url_encode(p_name || ' (' || p_size || ').pdf') AS url FROM part)""")
def hand_off(spark, sf_dir):
    """the address that hands a file over, and the name that is read back from it; other schemes are ignored."""
    name = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(").pdf"))
    quoted = F.regexp_replace(F.url_encode(name), r"\+", "%20")
    url = F.concat(F.when(F.col("p_partkey") % 5 == 0, "other").otherwise("folioscope"), F.lit("://open?name="), quoted)
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), url.alias("url"))
    return d.select("part", "url", F.when(F.col("url").startswith("folioscope://open?"), F.url_decode(F.regexp_extract("url", "name=([^&]*)", 1))).alias("opened"))

"""Scalar rules as queries: settings, names, formats, geometry, messages. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import estimate
from ..sources.adapters import register

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


@query("""SELECT part, round(300 * pow(72 / 300.0, a), 6) AS dpi, round(0.85 - 0.55 * a, 6) AS quality, a >= 0.75 AS gray, round(0.14 + 2.4 * (0.85 - 0.55 * a), 6) AS bits_per_pixel,
  round(least(1, greatest(0, ln(least(300, greatest(72, size * 8)) / 300.0) / ln(72 / 300.0))), 6) AS aggression FROM (SELECT p_partkey AS part, p_size AS size, p_partkey % 101 / 100.0 AS a FROM part)""")
def settings(spark, sf_dir):
    """F11, F16, F17, F19."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), (F.col("p_partkey") % 101 / 100.0).alias("a"))
    dpi, q, gray = estimate.setting(F.col("a"))
    return d.select("part", F.round(dpi, 6).alias("dpi"), F.round(q, 6).alias("quality"), gray.alias("gray"), F.round(estimate.bits_per_pixel(q), 6).alias("bits_per_pixel"), F.round(estimate.aggression((F.col("size") * 8).cast("double")), 6).alias("aggression"))


@query(r"""SELECT p_partkey AS part, regexp_replace(n, '\.[^.]*$', '') || '-reduced.pdf' AS output_name, CASE WHEN trim(translate(n, '/:', '--')) = '' THEN 'Document.pdf' ELSE trim(translate(n, '/:', '--')) END AS safe_name,
  CASE WHEN trim(n) = '' THEN NULL WHEN trim(n) LIKE '%.pdf' THEN trim(n) ELSE trim(n) || '.pdf' END AS renamed, lower(n) LIKE '%.pdf' AS accepted
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.v1.pdf' WHEN 1 THEN ' ' || p_name || '/a:b ' WHEN 2 THEN p_name || '.PDF' ELSE '  ' END AS n FROM part)""")
def names(spark, sf_dir):
    """F39, F40, F41, S18."""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    d = table(spark, sf_dir, "part").withColumn("n", F.when(k == 0, F.concat(n, F.lit(".v1.pdf"))).when(k == 1, F.concat(F.lit(" "), n, F.lit("/a:b "))).when(k == 2, F.concat(n, F.lit(".PDF"))).otherwise("  "))
    c = F.col("n")
    return d.select(F.col("p_partkey").alias("part"), T.output_name(c).alias("output_name"), T.safe_name(c).alias("safe_name"), T.renamed(c).alias("renamed"), F.lower(c).endswith(".pdf").alias("accepted"))


@query("""SELECT folder, min(k) AS suffix FROM (SELECT c_nationkey AS folder, unnest(range(1, CAST(count(*) AS BIGINT) + 2)) AS k FROM customer GROUP BY c_nationkey) s
  WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = folder AND c_custkey % 12 = k) GROUP BY folder""")
def free_suffix(spark, sf_dir):
    """The first number not taken in a folder; gaps are used again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), (F.col("c_custkey") % 12).alias("k"))
    tries = c.groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 1)).alias("k"))
    return tries.join(c.distinct(), ["folder", "k"], "left_anti").groupBy("folder").agg(F.min("k").alias("suffix"))


@query("""SELECT key, CASE WHEN b >= 1000000 THEN 'MB' ELSE 'KB' END AS unit, CASE WHEN b >= 1000000 THEN round(b / 1000000.0, 1) ELSE round(b / 1000.0, 0) END AS amount,
  CAST(floor(least(500, greatest(0.1, b / 1000000.0)) * 1000000) AS BIGINT) AS target_bytes, CASE WHEN b <= 0 THEN 0 ELSE CAST(round(100 * (1 - least(b, 200000000) / 200000000.0)) AS BIGINT) END AS percent
  FROM (SELECT o_orderkey AS key, CAST(floor(o_totalprice * 97) AS BIGINT) AS b FROM orders)""")
def byte_formats(spark, sf_dir):
    """Numbers are compared, not formatted strings."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") * 97).cast("long").alias("b"))
    unit, amount = T.byte_amount(F.col("b"))
    return d.select("key", unit.alias("unit"), amount.alias("amount"), T.target_bytes(F.col("b") / 1000000.0).alias("target_bytes"), T.percent_saved(F.lit(200_000_000), F.least("b", F.lit(200_000_000))).alias("percent"))


@query("""SELECT key, CASE WHEN pmod IN (90, 270) THEN h ELSE w END AS width, CASE WHEN pmod IN (90, 270) THEN w ELSE h END AS height FROM (SELECT key, pmod, CASE WHEN cw > 0 AND ch > 0 THEN cw ELSE mw END AS w, CASE WHEN cw > 0 AND ch > 0 THEN ch ELSE mh END AS h FROM
  (SELECT l_orderkey * 10 + l_linenumber AS key, ((l_linenumber * 90 - 360) % 360 + 360) % 360 AS pmod, l_quantity AS mw, l_extendedprice AS mh, l_quantity - 10 AS cw, CASE WHEN l_linenumber <> 3 THEN l_extendedprice - 5 END AS ch FROM lineitem))""")
def display_size(spark, sf_dir):
    """The crop box where it has an area, else the media box; turned pages have their sides swapped."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_linenumber") * 90 - 360).alias("r"), F.col("l_quantity").alias("mw"), F.col("l_extendedprice").alias("mh"), (F.col("l_quantity") - 10).alias("cw"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") - 5).alias("ch"))
    w, h = T.page_box(F.col("cw"), F.col("ch"), F.col("mw"), F.col("mh"))
    turned = F.pmod("r", F.lit(360)).isin(90, 270)
    return d.select("key", F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


@query(r"""SELECT key, CASE WHEN name IN ('lossless', 'sendit', 'small', 'tiny') THEN name END AS profile, greatest(0, 10 - least(10, greatest(0, want))) AS spent, 10 - greatest(0, 10 - least(10, greatest(0, want))) AS remaining,
  CASE WHEN stage = 0 THEN 'opening' WHEN stage = 1 THEN 'reading' WHEN stage = 2 THEN 'writing' ELSE 'an unknown step' END AS stage, a = b AS skip_export
  FROM (SELECT p_partkey AS key, lower(CASE p_partkey % 5 WHEN 0 THEN 'Lossless' WHEN 1 THEN 'SENDIT' WHEN 2 THEN 'small' WHEN 3 THEN 'Tiny' ELSE p_name END) AS name, p_size - 20 AS want, p_partkey % 4 AS stage, p_partkey % 7 AS a, p_size % 7 AS b FROM part)""")
def lookups(spark, sf_dir):
    """Profiles by name in any case, a reset of spent credits within 0 to 10, stages by number, equal sizes aren't exported anew."""
    k = F.col("p_partkey")
    name = F.lower(F.when(k % 5 == 0, "Lossless").when(k % 5 == 1, "SENDIT").when(k % 5 == 2, "small").when(k % 5 == 3, "Tiny").otherwise(F.col("p_name")))
    spent = F.greatest(F.lit(0), 10 - F.least(F.lit(10), F.greatest(F.lit(0), F.col("p_size") - 20)))
    stages = F.create_map(*(F.lit(x) for kv in enumerate(("opening", "reading", "writing")) for x in kv))
    return table(spark, sf_dir, "part").select(k.alias("key"), F.when(name.isin("lossless", "sendit", "small", "tiny"), name).alias("profile"), spent.alias("spent"), (10 - spent).alias("remaining"), F.coalesce(F.try_element_at(stages, (k % 4).cast("int")), F.lit("an unknown step")).alias("stage"), (k % 7 == F.col("p_size") % 7).alias("skip_export"))


@query("""SELECT key, round(sqrt((a * q) * (a * q) + (b * q) * (b * q)), 6) AS drawn_w, round(sqrt((c * p) * (c * p) + (d * p) * (d * p)), 6) AS drawn_h FROM
  (SELECT o_orderkey AS key, o_custkey % 7 AS a, o_custkey % 5 AS b, o_orderkey % 11 AS c, o_orderkey % 3 AS d, 2.5 AS q, 1.5 AS p FROM orders)""")
def drawn_size(spark, sf_dir):
    """a scaling concatenated in front of a transform; lengths of its two axes."""
    o = table(spark, sf_dir, "orders")
    a, b, c, d = F.col("o_custkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey") % 11, F.col("o_orderkey") % 3
    m = T.concatenated((F.lit(2.5), F.lit(0.0), F.lit(0.0), F.lit(1.5), F.lit(0.0), F.lit(0.0)), (a, b, c, d, F.lit(0.0), F.lit(0.0)))
    return o.select(F.col("o_orderkey").alias("key"), F.round(F.hypot(m[0], m[1]), 6).alias("drawn_w"), F.round(F.hypot(m[2], m[3]), 6).alias("drawn_h"))


@query("""SELECT key, CASE WHEN list_contains(f, 'jbig2') THEN 'jbig2' WHEN list_contains(f, 'dct') THEN 'dct' WHEN list_contains(f, 'flate') THEN 'flate' WHEN list_contains(f, 'lzw') THEN 'lzw' WHEN list_contains(f, 'runLength') THEN 'runLength' WHEN len(f) > 0 THEN 'other' ELSE 'none' END AS flt
  FROM (SELECT l_orderkey * 10 + l_linenumber AS key, CASE l_partkey % 7 WHEN 0 THEN [] WHEN 1 THEN ['flate'] WHEN 2 THEN ['ascii85', 'lzw'] WHEN 3 THEN ['flate', 'dct'] WHEN 4 THEN ['jbig2'] WHEN 5 THEN ['lzw', 'flate'] ELSE ['runLength'] END AS f FROM lineitem)""")
def deciding_filter(spark, sf_dir):
    """Aliases first, then the last filter that decides the image, else the best of the generic ones."""
    k = F.col("l_partkey") % 7
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    raw = F.when(k == 0, arr()).when(k == 1, arr("Fl")).when(k == 2, arr("A85", "LZW")).when(k == 3, arr("FlateDecode", "DCT")).when(k == 4, arr("JBIG2Decode")).when(k == 5, arr("LZWDecode", "Fl")).otherwise(arr("RL"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), T.image_filter(raw).alias("flt"))


@query("""SELECT doc_id, list_transform(list_filter(string_split(replace(source, 'src', '') || ', 3,x, 0 ,12', ','), lambda p: try_cast(trim(p) AS BIGINT) > 0), lambda p: try_cast(trim(p) AS BIGINT)) AS pages FROM documents""")
def page_list(spark, sf_dir):
    """numbers over 0 of a list with commas, the rest dropped."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.page_numbers(F.concat(F.regexp_replace("source", "src", ""), F.lit(", 3,x, 0 ,12"))).alias("pages"))


@query("""SELECT conv_id, CASE WHEN a IS NULL THEN '?' WHEN a = 0 THEN 'n/a' WHEN b = 0 THEN 'LOST' WHEN b / a >= 0.98 THEN 'yes' ELSE CAST(round(100 * b / a) AS BIGINT) || '%' END AS survived FROM
  (SELECT conv_id, sum(length(text)) AS a, sum(CASE WHEN turn < 3 THEN length(text) ELSE 0 END) AS b FROM conversations GROUP BY conv_id)""")
def text_retention(spark, sf_dir):
    """F45, F46, G20."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("a"), F.sum(F.when(F.col("turn") < 3, F.length("text")).otherwise(0)).alias("b"))
    return c.select("conv_id", T.survived(F.col("a"), F.col("b")).alias("survived"))


@query("""SELECT user_id, kind, count(*) AS n, kind <> 'unchanged' AS burns_credit FROM
  (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'compressed' WHEN 'click' THEN 'bestEffort' ELSE 'unchanged' END AS kind FROM events) GROUP BY ALL""")
def outcomes(spark, sf_dir):
    """What a run came to, and whether it produced a file."""
    e = F.col("event_type")
    kind = F.when(e == "purchase", "compressed").when(e == "click", "bestEffort").otherwise("unchanged")
    d = table(spark, sf_dir, "events").select("user_id", kind.alias("kind")).groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    return d.withColumn("burns_credit", F.col("kind") != "unchanged")


@query("""SELECT s_suppkey AS file, CAST(floor(s_acctbal * 100) AS BIGINT) AS produced, CAST(floor(s_acctbal * 100) AS BIGINT) < CAST(floor(500000 * 0.98) AS BIGINT) AS passes_size_gate FROM supplier""")
def size_gate(spark, sf_dir):
    """Less than 98 % of the input, truncated."""
    b = F.floor(F.col("s_acctbal") * 100).cast("long")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), b.alias("produced"), (b < F.floor(F.lit(500000) * 0.98).cast("long")).alias("passes_size_gate"))


@query()
def checksums(spark, sf_dir):
    """FNV-1a, Adler-32 and a deflate that is kept only if smaller; Arrow batches, tested on known answers."""
    return T.checksums(table(spark, sf_dir, "documents"))

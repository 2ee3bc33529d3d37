"""Operator 2, exact deduplication with a log-structured merge index, in DataFrame operations only.

* Memtables: each scan task digests its rows and flushes them as one run sorted by digest, a Parquet file with a
  Bloom filter on the digest column (point lookups by later batches skip runs through it).
* Compaction merges the runs: of each digest the smallest identifier and the count stay. Partial aggregation runs
  before the shuffle, so a digest that a third of all rows share costs one row per task.
* An index takes later batches: known() finds a batch's digests in the level, of which only the rows that a filter of
  the batch lets pass are shuffled, and compaction merges the batch's runs into the level.
* A bitmap filter of the contested digests, sized by their number, is broadcast to the second scan: only rows that may
  hit keep their text, and those hits are verified byte by byte against the text of the row that stays. Where the filter
  would be too large to broadcast, a semi-join by digest takes its place.
* If bytes differ under one digest, the rows of that digest are grouped anew by the text itself.

Defined cases: a null text counts as empty; rows that repeat a doc_id and a text share one decision; a null doc_id is
ignored when the smallest is chosen (a group of only null ids has keep_id null and is kept); an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_text, stored

#: Bits of a filter for each key, and its least and largest size; 2^28 bits are 32 MB, which is the most that is broadcast.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest(norm: Column, digest_bits: int = 256) -> Column:
    """SHA-256 of the UTF-8 text; fewer bits only to provoke collisions in tests."""
    full = F.unhex(F.sha2(norm.cast("binary"), 256))
    return full if digest_bits == 256 else F.substring(full, 1, digest_bits // 8)


def flush_runs(docs: DataFrame, digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, sha256: one sorted run for each scan task, stored with Bloom filters."""
    norm = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    runs = norm.select("doc_id", digest(F.col("norm")).alias("sha256")).withColumn("digest", F.substring("sha256", 1, digest_bits // 8))
    return stored(runs.sortWithinPartitions("digest", "doc_id"), "runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "1048576"})


def compact(runs: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """digest, keep_id, group_size: the runs merged, with an older level where there is one."""
    merged = runs.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    if level is not None:
        merged = merged.union(level).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return stored(merged.sortWithinPartitions("digest"), "level")


def known(level: DataFrame, runs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the level's rows whose digest a batch's runs have: candidates for byte verification."""
    digests = stored(runs.select("digest").distinct(), "digests")
    return may_hit(level, "digest", digests).join(digests, "digest", "left_semi")


def filter_bits(n: int) -> int:
    """Size of a filter for n keys, a power of two; 0 where that is too large to broadcast."""
    bits = max(LEAST_BITS, 1 << (KEY_BITS * n).bit_length())
    return bits if bits <= MOST_BITS else 0


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows (bucket, bitmap) of a one-hash Bloom filter over a column; at most bits / 32768 rows of 4 KB."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap"))


def bit_of(bitmap: str, position: str) -> Column:
    """The bit of a bitmap column at a position column."""
    return F.expr(f"shiftright(cast(conv(hex(substring({bitmap}, cast({position} div 8 + 1 as int), 1)), 16, 10) as int), cast({position} % 8 as int)) & 1")


def may_hit(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among keys (a stored table), all of those that are: by a filter, else by a semi-join. A null equals a null."""
    bits = filter_bits(keys.count())
    if not bits:
        return rows.join(keys.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    probed = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
    return probed.join(F.broadcast(bit_filter(keys, key, bits)), "_bucket").where(bit_of("_bitmap", "_bit") == 1).drop("_bucket", "_bit", "_bitmap")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids of dropped (doc_id). Rows that the filter of dropped ids clears aren't shuffled; null ids stay.

    The filter's columns have names that docs doesn't have.
    """
    own, tag = docs.columns, "_" * (1 + max(map(len, docs.columns)))
    ids = dropped.select(F.col("doc_id").alias(f"{tag}d")).distinct()
    size = filter_bits(dropped.count())
    if not size:
        return docs.join(ids, F.col(id_col).cast("long") == F.col(f"{tag}d"), "left_anti").select(own)
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(size))
    bits = bit_filter(dropped, "doc_id", size).toDF(f"{tag}b", f"{tag}m")
    probed = docs.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col(f"{tag}b"), "left").withColumn(f"{tag}p", F.bitmap_bit_position(at))
    hit = F.col(f"{tag}m").isNotNull() & (bit_of(f"{tag}m", f"{tag}p") == 1)
    probed = probed.withColumn(f"{tag}h", hit)
    clear = probed.where(~F.col(f"{tag}h")).select(own)
    met = probed.where(F.col(f"{tag}h")).select(own)
    return clear.union(met.join(ids, F.col(id_col).cast("long") == F.col(f"{tag}d"), "left_anti").select(own))


def exact_groups(docs: DataFrame, digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = flush_runs(docs, digest_bits, id_col, text_col)
    level = compact(runs)
    contested = level.where("group_size > 1")
    texts = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm"), digest_bits))
    hits = stored(may_hit(texts, "digest", contested), "hits")
    # joined by digest and id: the copies of one text spread over the tasks, and only the rows that stay meet by digest
    named = contested.select(F.col("digest").alias("_digest"), "keep_id")
    stays = hits.join(named, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # written, so that the next join reads two plain shuffles, of which adaptive execution splits a hot digest's partition
    stays = stored(stays.groupBy("digest").agg(F.min("norm").alias("keep_norm")), "stays")
    differ = stored(hits.join(stays, "digest").where(F.col("norm") != F.col("keep_norm")).select("digest"), "differ").distinct()
    found = runs.join(level, "digest")
    if not differ.isEmpty():
        again = hits.join(differ, "digest")
        own = again.groupBy("digest", "norm").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
        own = own.select("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256"), "own_keep", "own_size")
        found = found.join(own, ["digest", "sha256"], "left").withColumn("keep_id", F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_keep"))).withColumn("group_size", F.coalesce("own_size", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))

"""Operator 7, MinHash near-duplicates with sequential Bayesian verification.

* Documents with equal words form a class; classes are the nodes of everything that follows.
* Signatures of 120 minima. The limit is an argument, and bands follow from it: as wide as lets two sets at the limit
  miss every band with a probability of 1e-4 at most (20 bands of 6 at 0.85, 8e-5; 24 of 5 at 0.80, 7e-5).
* Buckets of a band are never expanded into all pairs. Each member meets its bucket's pivot first; only buckets that
  still hold several components go on. Such a bucket of more than BLOCK members is first split by a prefix filter: two
  sets at the limit share one of their shingles that are rarest in the bucket, so members meet by those alone. In a
  block, members outside the largest component meet the others inside the task, on signatures and then on whole sets
  of shingle hashes; a union-find leaves out what is joined already, so a block sends out a spanning forest: fewer
  links than it has components. Blocks of cells that even so are larger than BLOCK meet in pairs.
* A pair's signatures are compared 20 values at a time; it is dropped once the posterior probability of similarity
  at the limit falls under MISS. What survives is confirmed on the full shingle sets; links are proved on the texts.
* Components come from star contraction in DataFrames.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; with fewer than five
words the whole sequence is the one shingle; rows that repeat a doc_id are documents of their own that share the id;
a null doc_id never is a component's smallest unless all are null (component_id is then null, kept true); an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, id_text, release_caches, stored
from .components import components
from .exact_dedup import may_hit

WORDS = 5
#: The limit unless another is given.
PERCENT = 85
HASHES = 120
#: Probability of missing every band that a pair at the limit may have.
MISSED_BANDS = 1e-4
STEP = 20
#: Posterior probability under which a pair is dropped, at each of the comparisons of 20 values.
MISS = 1e-4
#: Members, and shingles of all members, that a block holds at most on average.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20)
    a = r.randint(0, 1 << 32, (2, HASHES), dtype=np.uint64)
    b = r.randint(0, 1 << 32, (2, HASHES), dtype=np.uint64)
    return (a[0] << np.uint64(32) | a[1]) | np.uint64(1), b[0] << np.uint64(32) | b[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (base, inverse))


def word_hashes(text: bytes, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes, by differences of prefix sums; long texts go block by block."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + block)
        if stop < len(text):  # a block ends at white space
            cut = max(text.rfind(c, at, stop) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:
                nexts = [k for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (k := text.find(c, stop)) >= 0]
                cut = min(nexts, default=len(text))
            stop = max(cut, at + 1)
        b = np.frombuffer(text, np.uint8, stop - at, at)
        gap = SPACES[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        s, e = edge[::2], edge[1::2]
        if s.size:
            size = max(block, 1 << (b.size - 1).bit_length())
            up, down = powers(size)
            sums = np.concatenate((np.zeros(1, np.uint64), (np.where(gap, 0, b.astype(np.uint64) + 1) * up[: b.size]).cumsum(dtype=np.uint64)))
            out.append(mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    w = word_hashes(text.lower())
    n = min(WORDS, w.size)
    if not n:
        return w
    h = np.full(w.size - n + 1, np.uint64(n))
    for k in range(n):
        h = mixed(h * ODD + w[k : w.size - n + 1 + k])
    return np.unique(h)


def signature(hashes: np.ndarray) -> bytes:
    a, b = permutations()
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, hashes.size, 2048):
        low = np.minimum(low, (a[:, None] * hashes[None, at : at + 2048] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def shingle_set(text: str) -> set[tuple[bytes, ...]]:
    w = text.encode().lower().split()
    n = min(WORDS, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and rows of each for a limit: the widest bands of which a pair at the limit shares one surely enough."""
    fits = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) <= MISSED_BANDS]
    if not fits:
        raise ValueError(f"signatures of {HASHES} values can't find pairs at {percent} %")
    return HASHES // max(fits), max(fits)


@functools.lru_cache(maxsize=4)
def least_matches(limit: float = PERCENT / 100, miss: float = MISS) -> tuple[int, ...]:
    """For each step: the matches so far under which the posterior (uniform prior) of similarity >= limit is below miss."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:  # P(Beta(m + 1, n - m + 1) >= limit) = P(Binomial(n + 1, limit) <= m)
            total += math.comb(n + 1, m) * limit**m * (1 - limit) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Indices of pairs of signature rows that stay after every step."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(percent / 100)):
        part = slice(k * STEP, (k + 1) * STEP)
        got = got + (a[alive, part] == b[alive, part]).sum(axis=1)
        stay = got >= least
        alive, got = alive[stay], got[stay]
        if not alive.size:
            break
    return alive


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, sig, row; key is a digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            key, n, sigs = [], [], []
            for t in b.column(1):
                raw = t.as_py().encode()
                h = shingle_hashes(raw)
                key.append(hashlib.sha256(b" ".join(raw.lower().split())).digest())
                n.append(h.size)
                sigs.append(signature(h) if h.size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n_shingles", "sig"])

    return stored(docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, sig binary").withColumn("row", F.monotonically_increasing_id()), "signed")


def word_key(text: str):
    """The digest of sign as a column."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(F.trim(F.regexp_replace(low, SPACE, " ")).cast("binary"), 256))


def pruned(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of distinct pairs (a, b) that no step of the comparison of signatures drops."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select([0, 1]).take(pa.array(survivors(rows_of(b.column(2)), rows_of(b.column(3)), percent)))

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return stored(both.mapInArrow(prune, "a long, b long"), "alive")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) that are linked by the shingles of their texts."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, own, keep = None, set(), []
            for i, (x, y, k) in enumerate(zip(b.column(2), b.column(3), b.column(1).to_pylist(), strict=True)):
                if k != last:
                    last, own = k, shingle_set(y.as_py())
                if linked(shingle_set(x.as_py()), own, percent):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return stored(both.mapInArrow(confirm, "a long, b long"), "links")


def opened(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, node, n, comp) of the buckets that hold several components."""
    known = members.join(comps, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("comp"))
    several = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    return stored(known.hint("merge").join(several, "bucket"), "open")  # a merge join's hot partitions can be split


def hashed_sets(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, sig, hashes) of the nodes among members: the sorted hashes of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                own = [shingle_hashes(t.as_py().encode()).view(np.int64) for t in part.column(2)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *(x.size for x in own)]).astype(np.int32), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["node", "sig", "hashes"])

    wanted = nodes.select("node", "sig").join(members.select("node").distinct(), "node", "left_semi").join(texts, "node")
    return stored(wanted.select("node", "sig", "text").mapInArrow(run, "node long, sig binary, hashes array<long>"), "sets")


def split_large(members: DataFrame, sets: DataFrame, percent: int = PERCENT, most: int = BLOCK) -> DataFrame:
    """(bucket, node, n, comp) with each bucket of more than ``most`` members in cells that lose no link.

    Sets x and y at the limit share percent % of either, so of the size - ceil(percent %) + 1 shingles of each that come
    first in any order they share one. The order is by frequency in the bucket, so most of these are in no other set.
    """
    large = stored(members.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > most).select("bucket"), "large")
    if large.isEmpty():
        return members
    each = members.hint("merge").join(large, "bucket").join(sets.select("node", "hashes"), "node").select("bucket", "node", "n", "comp", F.explode("hashes").alias("s"))
    often = each.groupBy("bucket", "s").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("bucket", "node").orderBy("c", "s"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    cells = each.hint("merge").join(often, ["bucket", "s"]).withColumn("rank", rank).where((F.col("rank") <= prefix) & (F.col("c") > 1))
    cells = stored(cells.select(F.xxhash64("bucket", "s").alias("bucket"), "node", "n", "comp"), "cells")
    several = cells.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    return members.join(large, "bucket", "left_anti").union(cells.hint("merge").join(several, "bucket").select(members.columns))


def forest(rows: pa.Table, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Links found between the components of a block's rows (node, comp, left, right, sig, hashes): left rows meet right ones.

    Components that are joined count as one from then on, so there are fewer links than components.
    """
    node, comp, left, right = (rows[x].to_numpy() for x in ("node", "comp", "left", "right"))
    sig = rows_of(rows["sig"])
    lists = rows["hashes"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    owner = np.repeat(np.arange(node.size), size)[np.argsort(shingle, kind="stable")]  # the block's index of shingles
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(shingle))))
    root = np.unique(comp, return_inverse=True)[1]
    a, b = [], []
    for k in np.flatnonzero(left):
        fits = right & (root != root[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
        other = np.flatnonzero(fits)
        alive = other[survivors(np.broadcast_to(sig[k], (other.size, HASHES)), sig[other], percent)]
        if not alive.size:
            continue
        own = shingle[start[k] : start[k + 1]]
        many = at[own + 1] - at[own]
        places = np.arange(many.sum()) + np.repeat(at[own] - np.cumsum(many) + many, many)
        both = np.bincount(owner[places], minlength=node.size)[alive]
        for x in alive[100 * both >= percent * (size[k] + size[alive] - both)]:
            if root[x] != root[k]:
                a.append(int(node[k]))
                b.append(int(node[x]))
                root[root == root[x]] = root[k]
    return a, b


def block_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, most: int = BLOCK) -> DataFrame:
    """Distinct links (a, b) that join the components of each bucket of (bucket, node, n, comp).

    A bucket is one block where it fits; else blocks of its members outside the largest component meet blocks of all.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"), F.sum("n").alias("n"))
    blocks = f"cast(ceil(greatest(m / {most}, n / {BLOCK_SHINGLES})) as int)"
    top = top.selectExpr("bucket", "top.comp as major", f"{blocks} as blocks", f"cast(ceil((m - top.c) * {blocks} / m) as int) as minors")
    own = members.hint("merge").join(top, "bucket").withColumn("h", F.xxhash64("node"))
    one = own.where("blocks = 1").selectExpr("bucket", "0 as i", "0 as j", "node", "comp", "comp != major as left", "true as right")
    grid = own.where("blocks > 1")
    minor = grid.where("comp != major").selectExpr("bucket", "cast(pmod(h, minors) as int) as i", "explode(sequence(0, blocks - 1)) as j", "node", "comp", "true as left", "false as right")
    every = grid.selectExpr("bucket", "explode(sequence(0, minors - 1)) as i", "cast(pmod(h, blocks) as int) as j", "node", "comp", "false as left", "true as right")
    dealt = one.union(minor).union(every).join(sets, "node").select("bucket", "i", "j", "node", "comp", "left", "right", "sig", "hashes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = forest(pa.Table.from_batches(held), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held, key = [], None
        for batch in batches:
            cell = np.stack([batch.column(k).to_numpy() for k in range(3)])
            ends = [*(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip([0, *ends], ends):
                if e > s:
                    if held and tuple(cell[:, s]) != key:
                        yield links(held)
                        held = []
                    key = tuple(cell[:, s])
                    held.append(batch.slice(s, e - s))
        if held:
            yield links(held)

    grouped = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return grouped.mapInArrow(meet, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept. Sets are linked from percent % on."""
    bands, width = banding(percent)
    rows = id_text(docs, id_col, text_col)
    signed = sign(rows)
    classes = signed.where("n_shingles > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("min_doc"), F.min_by("sig", "row").alias("sig"), F.min_by("doc_id", "row").alias("id"), F.min("n_shingles").alias("n"))
    nodes = stored(classes, "nodes")

    band = [F.xxhash64(F.lit(k), F.substring("sig", k * width * 4 + 1, width * 4)) for k in range(bands)]
    buckets = nodes.select("node", "n", F.explode(F.array(*band)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1")
    members = stored(buckets.hint("merge").join(shared, "bucket"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = stored(wanted.select("node", "key", "sig", "id"), "wanted")
    mine = may_hit(rows, "doc_id", wanted.select(F.col("id").alias("doc_id"))).withColumn("key", word_key("text"))  # the rows of the nodes, by their ids
    texts = stored(mine.join(wanted.select("key", "node"), "key").groupBy("node").agg(F.first("text").alias("text")), "texts")

    pairs = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    comps = stored(components(confirmed(pruned(pairs, wanted, percent), texts, percent)), "components")
    open_ = opened(members.where("m > 2").select("bucket", "node", "n"), comps)
    if not open_.isEmpty():
        sets = hashed_sets(open_, wanted, texts)
        found = stored(block_links(split_large(open_, sets, percent), sets, percent), "found")
        stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what is known, already contracted
        comps = stored(components(stars.union(confirmed(found, texts, percent))), "components")

    least = nodes.select("node", "min_doc").join(comps, "node").groupBy("component").agg(F.min("min_doc").alias("least"))
    named = nodes.select("key", "node", "min_doc").join(comps, "node", "left").join(least, "component", "left")
    named = named.select("key", F.when(F.col("component").isNull(), F.col("min_doc")).otherwise(F.col("least")).alias("component_id"))
    with_words = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(named, "key").select("doc_id", "n_shingles", "component_id")
    without = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.union(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

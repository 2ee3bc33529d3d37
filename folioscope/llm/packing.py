"""Operator 6, lexical retrieval packing: BM25 neighbours of a seed document greedily fill its window.

Texts are encoded once and the ids stored, with the document frequencies of all terms (token ids, so at most the
vocabulary) that each task has met. Documents are ordered by a sketch of their weightiest terms, common ones before
rare ones, and dealt by ranges of it, so that documents of like content meet wherever they are stored; places in the
table part those of one sketch. The bounds of the ranges come from a sample of sketches and bear on balance only.
Each task cuts what it has into shards of bounded size and builds an inverted index of each; a window's seed (the rest
of a cut document, else the first unused one) queries it with all its terms, and unused neighbours are laid in by
score. The neighbour that no longer fits is cut, and its rest seeds the next window, so windows are full; what a shard
has left at the end goes into sequences whose lengths are powers of two.

Defined cases: a null or empty text is its end id alone; a document longer than a window fills as many as it needs;
equal scores go to the earlier row; rows that repeat a doc_id are packed each; a row larger than a shard ends the one
it is in; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, release_caches, stored
from .piece_encoder import KEEP, shared_encoder

WINDOW = 2048
VOCABULARY = 1 << 16
#: A shard ends at so many tokens or documents.
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 4096
K1, B = 1.2, 0.75
#: Terms that one in so many documents of a shard has are laid out in full, which takes at most so many cells for each posting.
COMMON = 8
#: Texts that are encoded together at most; a batch ends them as well.
TOGETHER = 4096
#: Levels of a sketch: terms that a fifth of all documents have at least, then an eighth of that, and so on.
LEVELS, COARSEST, FINER = 6, 5, 8
#: Ranges are dealt so that they fill a shard to this share, as their bounds come from a sample of so many sketches each.
FILLED, SAMPLED = 0.8, 30
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, keep: int = KEEP) -> DataFrame:
    """(doc_id, ids, df), stored. ids: little-endian unsigned 16-bit with the end id. A task's last row has only df:
    64-bit numbers of its documents with each term, then of its documents and of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = shared_encoder(tokenizer, kind, keep), int(end_id).to_bytes(2, "little")
        encode = enc.encode_all if kind == "word" else lambda texts: list(map(enc.encode, texts))
        df, n, tokens = np.zeros(VOCABULARY, np.int64), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                ids = [x + tail for x in encode(part.column(1).to_pylist())]
                for some in portions([np.frombuffer(x, "<u2") for x in ids]):
                    df += np.bincount(postings(some)[1], minlength=VOCABULARY)
                n, tokens = n + len(ids), tokens + sum(map(len, ids)) // 2
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([np.append(df, (n, tokens)).tobytes()])], ["doc_id", "ids", "df"])

    return stored(id_text(docs).mapInArrow(run, "doc_id long, ids binary, df binary"), "ids")


#: Ids and documents that are sorted together at most.
PORTION, PORTION_DOCS = 1 << 18, 4096


def portions(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in order, in lists of bounded size (a larger document is alone in its list)."""
    held, n = [], 0
    for d in docs:
        if held and (n + d.size > PORTION or len(held) >= PORTION_DOCS):
            yield held
            held, n = [], 0
        held.append(d)
        n += d.size
    if held:
        yield held


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of documents, their distinct terms in ascending order, and how often each occurs; all documents in one sort."""
    sizes = [d.size for d in docs]
    keys = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes) << 16
    keys |= np.concatenate([*docs, np.zeros(0, "<u2")])
    keys.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(1, keys.size), bool), keys[1:] != keys[:-1])))
    own = keys[at]
    return (own >> 16).astype(np.int64), (own & 0xFFFF).astype(np.int64), np.diff(at, append=keys.size)


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms in ascending order, and how often each occurs."""
    return postings([ids])[1:]


def document_frequencies(encoded: DataFrame) -> tuple[int, int, np.ndarray]:
    """Number of documents, of ids, and of documents with each term; at most one row for each term reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()  # of the encoding before
        total = np.zeros(VOCABULARY + 2, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "n": total[at]})

    total = np.zeros(VOCABULARY + 2, np.int64)
    for r in encoded.where("df is not null").select("df").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r.term] = r.n
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(term: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms in documents of these sizes."""
    return idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))


class Sketcher:
    """Sketches of documents: of each its weightiest term of each level of frequency, from common to rare, as bytes in that order."""

    def __init__(self, n: int, df: np.ndarray, idf: np.ndarray, mean: float):
        least = [max(2, n / (COARSEST * FINER**k)) for k in range(LEVELS)]
        #: The first level that has a term; levels behind it have it as well.
        self.level = np.array([(df < x) for x in least]).sum(axis=0)
        self.idf, self.mean = idf, mean

    def __call__(self, docs: list[np.ndarray]) -> list[bytes]:
        return [x for some in portions(docs) for x in self.together(some)]

    def together(self, docs: list[np.ndarray]) -> list[bytes]:
        doc, term, tf = postings(docs)
        out = np.full((len(docs), LEVELS), VOCABULARY - 1, ">u2")
        if doc.size:
            w = weights(term, tf, np.array([d.size for d in docs])[doc], self.idf, self.mean)
            level, first = self.level[term], np.flatnonzero(np.diff(doc, prepend=-1))
            for k in range(LEVELS):
                own = np.where(level <= k, w, -1.0)
                top = np.flatnonzero((own == np.repeat(np.maximum.reduceat(own, first), np.diff(first, append=doc.size))) & (own >= 0))
                top = top[np.flatnonzero(np.diff(doc[top], prepend=-1))]  # the least term of equals
                out[doc[top], k] = term[top]
        return [x.tobytes() for x in out]


def placed(ids: DataFrame, n: int, tokens: int, df: np.ndarray) -> DataFrame:
    """(doc_id, ids) in the order of sketches, in ranges of about a shard."""
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, tokens / max(1, n))
    spark = ids.sparkSession
    shared = spark.sparkContext.broadcast((df, idf))  # one number for each term
    ranges = max(1, math.ceil(tokens / (FILLED * SHARD_TOKENS)), math.ceil(n / (FILLED * SHARD_DOCS)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        of = Sketcher(n, *shared.value, mean)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = of([np.frombuffer(x.as_buffer(), "<u2") for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], ["doc_id", "ids", "row", "sketch"])

    rows = ids.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    made = "doc_id long, ids binary, row long, sketch binary"
    sample = rows.sample(min(1.0, SAMPLED * ranges / max(1, n)), seed=6) if ranges > 1 else rows.limit(0)
    # a sketch for each SAMPLED-th of a range: 20 bytes for about a million ids
    keys = sorted((bytes(r.sketch), r.row) for r in sample.mapInArrow(sketch, made).select("sketch", "row").collect())
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    given = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sketch(batches):
            cell = [bisect.bisect_right(given.value, x) for x in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    return rows.mapInArrow(deal, f"{made}, cell int").repartition(ranges, "cell").sortWithinPartitions("cell", "sketch", "row").select("doc_id", "ids")


class Shard:
    """The inverted index of some documents, and their packing."""

    def __init__(self, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.doc_ids, self.docs = doc_ids, docs
        doc, term, tf = postings(docs)
        self.query = np.split(term, np.cumsum(np.bincount(doc, minlength=len(docs)))[:-1])
        weight = weights(term, tf, np.array([d.size for d in docs])[doc], idf, mean)
        order = np.argsort(term.astype(np.uint16), kind="stable")  # by radix
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(term, minlength=VOCABULARY))))
        common = np.flatnonzero(np.diff(self.at) * COMMON >= max(COMMON, len(docs)))
        self.line = np.full(VOCABULARY, -1)
        self.line[common] = np.arange(common.size)
        line = self.line[term[order]]
        self.table, self.column = np.zeros((common.size, len(docs)), np.float32), np.arange(len(docs))
        self.table[line[line >= 0], self.doc[line >= 0]] = self.weight[line >= 0]
        self.keep(line < 0)
        self.unused, self.left, self.held = np.ones(len(docs), bool), len(docs), len(docs)

    def keep(self, stay: np.ndarray) -> None:
        """Leave other postings out of the index."""
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(stay)))[self.at]
        self.doc, self.weight = self.doc[stay], self.weight[stay]

    def shrink(self) -> None:
        """Leave used documents out of the index."""
        self.keep(self.unused[self.doc])
        stay = self.unused[self.column]
        self.table, self.column, self.held = self.table[:, stay], self.column[stay], self.left

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents by BM25 score for all of the seed's terms, the best 64 and those that equal the last of them."""
        if self.left < 0.7 * self.held:
            self.shrink()
        terms = self.query[seed]
        line = self.line[terms]
        start, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)  # of all their postings
        score = np.bincount(self.doc[at], self.weight[at], len(self.docs)).astype(float)  # whole numbers where there are none
        score[self.column] += self.table[line[line >= 0]].sum(axis=0)
        score *= self.unused
        least = np.partition(score, -64)[-64] if score.size > 64 else 0.0
        top = np.flatnonzero((score >= least) & (score > 0))
        return top[np.lexsort((top, -score[top]))].tolist()

    def order(self) -> Iterator[int]:
        """Documents in packing order: told the room left in the window, each neighbour of its seed, then the next unused."""
        first, n, seed, filled, near = 0, len(self.docs), None, 0, []
        while True:
            near = [d for d in near if self.unused[d]]
            if seed is not None and not near and filled:
                near = self.neighbours(seed)
            if near:
                d = near.pop(0)
            else:
                while first < n and not self.unused[first]:
                    first += 1
                if first == n:
                    return
                d = first
            self.unused[d] = False
            self.left -= 1
            if not filled:
                seed, near = d, []
            whole = filled + self.docs[d].size
            if whole >= WINDOW:
                seed, near = d, []  # the rest of a cut document seeds the next window
            filled = whole % WINDOW
            yield d

    def pack(self, sequence: int) -> tuple[list[tuple], int]:
        """Pieces as rows of PIECES, and the next free sequence id."""
        order = list(self.order())
        total = sum(self.docs[d].size for d in order)
        sizes = [WINDOW] * (total // WINDOW) + [1 << k for k in range(WINDOW.bit_length() - 2, -1, -1) if total % WINDOW >> k & 1]
        rows, k, offset = [], 0, 0
        for d in order:
            ids, start = self.docs[d].astype("<u4"), 0
            while start < ids.size:
                n = min(ids.size - start, sizes[k] - offset)
                rows.append((self.doc_ids[d], start, n, zlib.crc32(ids[start : start + n]), ids.size, sequence + k, offset))
                start, offset = start + n, offset + n
                if offset == sizes[k]:
                    k, offset = k + 1, 0
        return rows, sequence + k


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, keep: int = KEEP) -> DataFrame:
    """One row for each piece. Sequence ids are unique: the task's number, then a count. keep: see KEEP; it bears on speed only."""
    encoded = encode_documents(docs, tokenizer, kind, end_id, keep)
    n, tokens, df = document_frequencies(encoded)
    ids = encoded.where("ids is not null").select("doc_id", "ids")
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))  # one number for each term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        sequence = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in PIECES.split(", ")]
        doc_ids, held, tokens = [], [], 0  # of one shard

        def flush():
            nonlocal sequence, doc_ids, held, tokens
            rows, sequence = Shard(doc_ids, held, shared.value, max(1.0, tokens / len(held))).pack(sequence)
            doc_ids, held, tokens = [], [], 0
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], names)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(i)
                held.append(np.frombuffer(x.as_py(), "<u2"))
                tokens += held[-1].size
                if tokens >= SHARD_TOKENS or len(held) >= SHARD_DOCS:
                    yield from flush()
        if held:
            yield from flush()

    return placed(ids, n, tokens, df).mapInArrow(run, PIECES)


def padding(lengths: list[int]) -> int:
    """Ids of padding that sequences of these lengths need: none at a power of two, else up to a window."""
    return sum(0 if n & (n - 1) == 0 else WINDOW - n for n in lengths if n) if math.log2(WINDOW).is_integer() else 0

"""Operator 4, language-model scoring by subword lattice likelihood.

The pieces are those of an existing vocabulary; their scores give the prior weights. One round of expectation counts
over all training words (forward and backward over every segmentation) turns prior and corpus into piece
probabilities, with an end piece for each document. A word's marginal is the log-space forward recursion over its
lattice; a document's score is the sum over its words and the end. Pieces don't cross white space.

Counts are one row for each distinct token of the whole table. Scoring reads each document once: tokens counted often
(a bounded dictionary, chosen by count) are summed in the task, all other tokens go by the token to the count table
through a shuffle; none is dropped.

Defined cases: null and empty texts have the end token alone; a token of any length is one lattice, recursion is
linear in it; rows that repeat a doc_id are scored each; with no training rows all counts are 0 and N is 0 (V is 0);
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_text, stored

#: Bounds of the dictionary that goes to the tasks: tokens, and bytes of each.
HOT_TOKENS, HOT_BYTES = 1 << 17, 64
FLUSH = 1 << 19
#: Weight of the prior, in pieces.
PRIOR = 20_000.0
END = "\n"  # cannot be a token
LN10 = math.log(10)


class Pieces:
    """The vocabulary of a sentencepiece file and an automaton of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(sp.piece_to_id(p)) for p in self.names])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        self.size = len(self.names) + 256 + 1  # pieces, bytes, end
        prior = np.concatenate((1.0 / (rank + 10.0), np.full(256, 1e-4), [1e-3]))
        self.prior = prior / prior.sum()
        self.single = {p for p in self.names if len(p) == 1}
        self.auto = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()

    def lattice(self, words: list[str]):
        """Edges of all words: start, end (word-wise nodes laid one after another), piece; byte edges carry several ids.

        Returns nodes' offsets within their word, each word's first and last node, and the edge arrays.
        """
        marked = ["▁" + w for w in words]
        text = "\n".join(marked)
        got = [(end, x[0], x[1]) for end, x in self.auto.iter(text)]
        e, k, n = (np.array(c, np.int64) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        lengths = np.array([len(m) for m in marked])
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        last = first + lengths
        bytes_at, bytes_of = [], []
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = np.array([ord(c) for c in sorted(self.single)], np.uint32)
        odd = np.ones(codes.size, bool)
        if known.size:
            at = np.minimum(np.searchsorted(known, codes), known.size - 1)
            odd = known[at] != codes
        odd[last[:-1]] = False
        for i in np.flatnonzero(odd):
            bytes_at.append(int(i))
            bytes_of.append([len(self.names) + b for b in chr(codes[i]).encode()])
        return first, last, e - n + 1, e + 1, k, np.array(bytes_at, np.int64), bytes_of

    def marginals(self, words: list[str], logp: np.ndarray, counts: np.ndarray | None = None):
        """Natural-log marginal of each word; with counts also the expected number of each piece."""
        if not words:
            return np.zeros(0), np.zeros(self.size)
        first, last, s, e, k, byte_at, byte_of = self.lattice(words)
        byte_lp = np.array([logp[b].sum() for b in byte_of])
        src, dst = np.concatenate((s, byte_at)), np.concatenate((e, byte_at + 1))
        lp = np.concatenate((logp[k], byte_lp))
        nodes = int(last[-1]) + 1
        home = np.repeat(first, last - first + 1)
        depth = np.arange(nodes) - home
        alpha = np.full(nodes, -np.inf)
        alpha[first] = 0.0

        def sweep(value, frm, to, level):
            order = np.lexsort((to, level))
            frm, to, w, level = frm[order], to[order], lp[order], level[order]
            cuts = np.flatnonzero(np.diff(level)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [level.size])), strict=True):
                target = to[lo:hi]
                heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
                value[target[heads]] = np.logaddexp.reduceat(value[frm[lo:hi]] + w[lo:hi], heads)

        sweep(alpha, src, dst, depth[dst])
        z = alpha[last]
        if counts is None:
            return z, None
        beta = np.full(nodes, -np.inf)
        beta[last] = 0.0
        sweep(beta, dst, src, -depth[src])
        word = np.repeat(np.arange(len(words)), last - first + 1)
        share = np.exp(alpha[src] + lp + beta[dst] - z[word[src]]) * counts[word[src]]
        expected = np.bincount(k, share[: k.size], self.size)
        for x, ids in zip(share[k.size :], byte_of, strict=True):
            np.add.at(expected, ids, x)
        return z, expected


def batches_of(words: list[str], chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of about so many characters; what is longer goes alone."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > chars:
            yield at, i
            at, size = i, 0
        size += len(w) + 2
    if words:
        yield at, len(words)


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c): counts among training rows for every token of the table; the end token is END. docs: text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), set()

        def flush():
            keys = list(train) + [t for t in rest if t not in train]
            n = list(train.values()) + [0] * (len(keys) - len(train))
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array(n, pa.int64())], ["token", "c"])

        for b in batches:
            for t, held in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = tokens_of(t.as_py())
                if held:
                    rest.update(words)
                else:
                    train.update(words)
                    train[END.encode()] += 1
                if len(train) + len(rest) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text", "held_out").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def fit_pieces(counts: DataFrame, model: str, n_docs: int) -> np.ndarray:
    """Log-probabilities of pieces, bytes and end from prior and expected counts over all training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        logp, total = np.log(pieces.prior), np.zeros(pieces.size)
        for b in batches:
            words, n = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), float)
            for lo, hi in batches_of(words):
                total += pieces.marginals(words[lo:hi], logp, n[lo:hi])[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": at, "n": total[at]})

    pieces = Pieces(model)
    p = PRIOR * pieces.prior
    seen = counts.where((F.col("c") > 0) & (F.col("token") != END)).select("token", "c")
    for r in seen.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        p[r.piece] += r.n
    p[-1] += n_docs
    return np.log(p / p.sum())


def weigh(counts: DataFrame, model: str, logp: np.ndarray, base_n: int, base_v: int) -> DataFrame:
    """(token, c, base, lattice): log10 contributions of one occurrence."""
    shared = counts.sparkSession.sparkContext.broadcast(logp)  # one number for each piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        lp = shared.value
        for b in batches:
            words, c = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.int64)
            z = np.empty(len(words))
            for lo, hi in batches_of(words):
                z[lo:hi] = pieces.marginals(words[lo:hi], lp)[0]
            z[[i for i, w in enumerate(words) if w == END]] = lp[-1]
            base = np.log10((c + 0.5) / (base_n + 0.5 * (base_v + 1)))
            yield pa.RecordBatch.from_pydict({"token": b.column(0), "c": c, "base": base, "lattice": z / LN10})

    return counts.mapInArrow(run, "token string, c long, base double, lattice double")


def hot_tokens(weights: DataFrame) -> dict[bytes, tuple[int, float, float]]:
    """The tokens with the largest counts, as many as surely fit the bounds: whole classes of counts, an eighth of a power of two wide."""
    short = weights.where((F.octet_length("token") <= HOT_BYTES) & (F.col("c") > 0)).withColumn("class", F.floor(F.log2("c") * 8))
    classes = sorted(((r["class"], r.n) for r in short.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for k, n in classes:
        total += n
        if total > HOT_TOKENS:
            break
        least = k
    if least is None:
        return {}
    return {r.token.encode(): (r.c, r.base, r.lattice) for r in short.where(F.col("class") >= least).collect()}


def score_documents(docs: DataFrame, weights: DataFrame, end: tuple[int, float, float]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score. docs: doc_id, text, held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_tokens(weights))
    names = ["row", "token", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = pa.schema([("row", pa.int64()), ("token", pa.string()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                out = [[] for _ in names]
                own = b.slice(at, 512)
                for row, doc_id, text, held in zip(*(c.to_pylist() for c in own.columns), strict=True):
                    words = Counter(tokens_of(text))
                    known, base, score = (1 if end[0] else 0), end[1], end[2]
                    for w, n in words.items():
                        got = hot.get(w)
                        if got is None:
                            out[0].append(row)
                            out[1].append(w.decode())
                            out[2].append(n)
                        else:
                            known += n
                            base += n * got[1]
                            score += n * got[2]
                    for c in out[3:]:
                        c.extend([None] * (len(out[0]) - len(c)))
                    for c, v in zip(out, (row, f" {row}", 0, doc_id, held, sum(words.values()) + 1, known, base, score), strict=True):
                        c.append(v)  # a document's own row has a key that no token is
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(run, "row long, token string, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    met = rows.join(weights, "token", "left")
    add = lambda own, x: F.sum(F.coalesce(F.col(own), F.col("times") * x)).alias(own)
    done = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        add("n_known", F.when(F.col("c") > 0, 1).otherwise(0)),
        add("base_score", F.col("base")),
        add("score", F.col("lattice")),
    )
    return done.drop("row")


def lattice_scores(docs: DataFrame, model: str) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 is not 1, score all rows."""
    rows = id_text(docs).withColumn("held_out", fold("doc_id", 5) == 1)
    counts = stored(count_tokens(rows), "counts")
    n, v = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    ends = (counts.where(F.col("token") == END).agg(F.sum("c")).first()[0]) or 0
    logp = fit_pieces(counts, model, ends)
    weights = stored(weigh(counts, model, logp, n, v), "weights")
    end = (ends, math.log10((ends + 0.5) / (n + 0.5 * (v + 1))), float(logp[-1]) / LN10)
    scored = score_documents(rows, weights, end)
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

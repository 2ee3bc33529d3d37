"""Operator 8, toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises.

Folding lower-cases, maps homoglyphs, full-width forms, digits and signs to Latin letters, drops zero-width characters
and turns everything else that isn't a letter into a space. The lexicon holds whole words (of two letters at least) and
beginnings of words (4 to 8 letters) that occur in at least a 500th of the toxic training rows and whose weight is the log odds of occurring in toxic against clean training rows; a longer entry stays beside
its beginning only if it says more, and at each word the longest entry counts. Accented letters are told apart, but
strong plain entries also match words that only accents disguise. Exception phrases (an entry with its neighbouring word) cancel a match: a fixed list and those
learned from clean training rows. The score is a logistic function of the weight found and of the weight for each
hundred words, fitted on a bounded sample of labelled rows.

Defined cases: null and empty texts have no match and get the score of none; rows without a label are scored only;
with no toxic label the lexicon is empty and all scores are low; a doc_id labelled twice counts as toxic if any label
says so; a very long text is one row's worth of memory; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, id_text, keep_rows, stored
from .exact_dedup import bit_of, may_hit

#: Look-alike letters of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɡ": "g", "ɑ": "a",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
ZERO_WIDTH = "­​‌‍⁠﻿"
#: Fixed phrases in which an entry isn't meant as an insult.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "stupid mistake", "pathetic fallacy", "sore loser")

STEMS, SHORTEST = range(4, 9), 2
#: What an entry must show: toxic training rows, weight, and log-likelihood gained over chance (many are tried).
LEAST_ROWS, LEAST_WEIGHT, LEAST_GAIN = 4, 1.2, 14.0
#: An entry is in one of so many toxic rows at least, an exception phrase in one of so many clean ones and in three.
#: So there are at most 500 times as many candidates as a toxic row has entries, and these may reach the driver.
SUPPORT, PHRASE_SUPPORT = 500, 20_000
#: Labels go to the scan as exact bitmaps while these have so many bytes at most; else texts and labels are shuffled.
LABEL_BYTES = 32 << 20
#: A longer entry stays beside its beginning if its weight is so much more; entries of this weight see through accents.
MORE, STRONG = 0.7, 5.0
#: Keys that a task sums up before it sends them on.
FLUSH = 200_000
#: The logistic function is fitted on at most so many labelled rows.
FIT_ROWS = 20_000


class Fold(dict):
    """Code point to its folded text, worked out when first met."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        low = c.lower()
        low = HOMOGLYPHS.get(low, low)
        low = DIGITS.get(low, low)
        if c in ZERO_WIDTH:
            low = ""
        elif not low.isascii():
            low = unicodedata.normalize("NFKC", low).lower()
            low = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in low)
        out = "".join(x if x.isalpha() else " " for x in low) if low else ("" if c in ZERO_WIDTH or unicodedata.combining(c) else " ")
        self[cp] = out
        return out


class Strip(dict):
    """Code point to its letter without accents, one for one."""

    def __missing__(self, cp: int) -> str:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        self[cp] = base
        return base


FOLD, STRIP = Fold(), Strip()


def folded(text: str) -> str:
    """Folded words, one space before each and one at the end. Signs inside a word fold to letters, those around it go."""
    return " " + " ".join(w for t in text.split() if (w := t.strip("!|.,;:?\"'()[]{}").translate(FOLD))) + " "


def entries(text: str, wanted: frozenset[str] | None = None) -> set[str]:
    words = set(folded(text).split())
    got = {w[:k] for w in words for k in STEMS if len(w) >= k} | {w + " " for w in words if len(w) >= SHORTEST}
    return got if wanted is None else got & wanted


class Lexicon:
    """Weights by beginning of word, exception phrases, and the logistic function's three numbers."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(EXCEPTIONS), coef: tuple[float, float, float] = (-4.0, 1.0, 0.2)):
        self.weights, self.exceptions, self.coef = weights, set(exceptions), coef
        self.auto = ahocorasick.Automaton()
        for w, v in weights.items():
            self.auto.add_word(" " + w, (w, v))
        if weights:
            self.auto.make_automaton()

    def matches(self, text: str) -> tuple[list[tuple[int, str, float]], str]:
        """(start, entry, weight) of the longest entry at each word, without those that an exception phrase covers."""
        s = folded(text)
        if not self.weights:
            return [], s
        best: dict[int, tuple[str, float]] = {}
        for end, (w, v) in self.auto.iter(s):
            at = end - len(w) + 1
            if at not in best or len(w) > len(best[at][0]):
                best[at] = w, v
        if not s.isascii():
            for end, (w, v) in self.auto.iter(s.translate(STRIP)):
                at = end - len(w) + 1
                if at not in best and v >= STRONG and w.isascii():
                    best[at] = w, v
        return [(at, w, v) for at, (w, v) in best.items() if not any(p in self.exceptions for p in phrases(s, at))], s

    def features(self, text: str) -> tuple[float, float, int]:
        found, s = self.matches(text)
        total = sum(v for *_, v in found)
        return math.log1p(total), math.log1p(100.0 * total / max(20, s.count(" ") - 1)), len(found)

    def score(self, text: str) -> tuple[float, int]:
        a, b, n = self.features(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), n


def phrases(s: str, at: int) -> list[str]:
    """The word at a place of folded text with its neighbour on either side."""
    end = s.find(" ", at)
    word, out = s[at:end], []
    if at > 1:
        out.append(s[s.rfind(" ", 0, at - 1) + 1 : end])
    nxt = s.find(" ", end + 1)
    if nxt > 0:
        out.append(f"{word} {s[end + 1 : nxt]}")
    return out


def tally(rows: DataFrame, keys: Callable[[str], Iterable[str]]) -> DataFrame:
    """(key, n): in how many rows of text each key that keys(text) gives occurs; summed in the task, FLUSH keys at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(keys(t.as_py()))
                if len(c) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(c, pa.string()), "n": pa.array(c.values(), pa.int64())})
                    c.clear()
        yield pa.RecordBatch.from_pydict({"key": pa.array(c, pa.string()), "n": pa.array(c.values(), pa.int64())})

    return rows.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> tuple[float, float, float]:
    """Newton's method with a ridge on all but the constant; slopes below zero are set to zero."""
    design = np.column_stack((np.ones(len(x)), x))
    weight = np.ones(len(y))
    beta = np.zeros(design.shape[1])
    keep = np.ones(design.shape[1], bool)
    for _ in range(2):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design[:, keep] @ beta[keep], -30, 30)))
            pen = np.diag([0.0 if i == 0 else ridge * len(y) / 100 for i in np.flatnonzero(keep)])
            grad = design[:, keep].T @ (weight * (y - p)) - pen @ beta[keep]
            hess = (design[:, keep] * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design[:, keep] + pen + 1e-6 * np.eye(keep.sum())
            step = np.linalg.solve(hess, grad)
            beta[keep] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        bad = (beta < 0) & (np.arange(beta.size) > 0)
        if not bad.any():
            break
        keep &= ~bad
        beta[:] = 0
    return tuple(float(b) for b in beta)


def weighed(often: dict[str, int], in_clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries that show enough, by their counts in toxic and in clean rows."""
    weight = {k: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(k, 0) + 0.5) / (n_clean + 1)) for k, n in often.items()}
    chance = {k: n_toxic * (in_clean.get(k, 0) + 0.5) / (n_clean + 1) for k in weight}
    gain = {k: n * math.log(n / chance[k]) - n + chance[k] for k, n in often.items()}
    good: dict[str, float] = {}
    for k in sorted((k for k in weight if weight[k] >= LEAST_WEIGHT and gain[k] >= LEAST_GAIN), key=lambda k: (len(k), k)):
        inner = max((good[k[:j]] for j in STEMS if j < len(k) and k[:j] in good), default=0.0)
        if weight[k] >= inner + MORE:
            good[k] = weight[k]
    return good


def train_lexicon(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn from (text, toxic). Counts cover all rows; only entries with enough support reach the driver."""
    toxic, clean = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return Lexicon({})
    spark = labelled.sparkSession
    least = max(min(LEAST_ROWS, max(2, n_toxic // 50)), -(-n_toxic // SUPPORT))
    often = {r.key: r.n for r in tally(toxic, entries).where(F.col("n") >= least).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(often))
    in_clean = {r.key: r.n for r in tally(clean, lambda t: entries(t, wanted.value)).collect()}
    lexicon = Lexicon(weighed(often, in_clean, n_toxic, n_clean))
    shared = spark.sparkContext.broadcast(lexicon.weights)

    def near(text, cache={}):  # noqa: B006  one lexicon for each task
        if not cache:
            cache["lexicon"] = Lexicon(shared.value)
        found, s = cache["lexicon"].matches(text)
        return {p for at, *_ in found for p in phrases(s, at)}

    odd = {r.key: r.n for r in tally(clean, near).where(F.col("n") >= max(3, -(-n_clean // PHRASE_SUPPORT))).collect()}
    if odd:
        kept = spark.sparkContext.broadcast(frozenset(odd))
        bad = {r.key: r.n for r in tally(toxic, lambda t: near(t) & kept.value).collect()}
        lexicon = Lexicon(lexicon.weights, set(EXCEPTIONS) | {k for k, n in odd.items() if n / n_clean > 4 * bad.get(k, 0) / n_toxic})
    chosen = spark.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def make():
        lex = Lexicon(*chosen.value)

        def f(x):
            got = [lex.features(t) for t in x["text"]]
            return {"a": [g[0] for g in got], "b": [g[1] for g in got], "y": x["toxic"], "h": x["h"]}

        return f

    narrow = arrow_map(labelled.select("text", "toxic", F.xxhash64("text").alias("h")), make, "a double, b double, y int, h long")
    sample = narrow.orderBy("h", "a", "b", "y").limit(fit_rows).collect()
    lexicon.coef = fit_logistic(np.array([(r.a, r.b) for r in sample]), np.array([r.y for r in sample]))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_matches."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.coef))

    def make():
        lex = Lexicon(*shared.value)

        def f(x):
            got = [lex.score(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "score": [g[0] for g in got], "predicted": [int(g[0] >= threshold) for g in got], "n_matches": [g[1] for g in got]}

        return f

    return arrow_map(id_text(docs, id_col, text_col), make, "doc_id long, score double, predicted int, n_matches int")


def keep_civil(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Whole rows that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.coef))

    def make():
        lex = Lexicon(*shared.value)
        return lambda t: lex.score(t or "")[0] < threshold

    return keep_rows(docs, make)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows whose crc32(doc_id) mod 3 is not 1.

    The labels are two exact bitmaps of ids; where these are small, no text is shuffled.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = id_text(docs).where(fold("doc_id", 3) != 1)
    at = F.bitmap_bit_position("doc_id")
    bits = own.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(at).alias("any"), F.bitmap_construct_agg(F.when(F.col("toxic") == 1, at)).alias("bad"))
    bits = stored(bits, "label_bits")
    if 2 * 4096 * bits.count() > LABEL_BYTES:
        own = stored(own, "labels")
        return may_hit(rows, "doc_id", own).join(own, "doc_id").select("text", "toxic")
    met = rows.withColumn("bucket", F.bitmap_bucket_number("doc_id")).withColumn("bit", at).join(F.broadcast(bits), "bucket")
    return met.where(bit_of("any", "bit") == 1).select("text", bit_of("bad", "bit").cast("int").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = train_lexicon(stored(training_rows(docs, labels), "labelled"))
    return score_toxicity(docs, lexicon).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted", "n_matches")

"""Operator 3, language identification by multilingual mixture inference.

Training counts letter trigrams of each language over all training rows. For a document, expectation-maximisation
estimates the share of each language in its trigrams; the set of languages is chosen by likelihood less a penalty for
each language beyond the first. The predicted language has the largest share; its share is the score.

Letters fold to 63 symbols (a-z, and other letters by code point), everything else to one word break, so the model
has 64^3 cells for each language, whatever the corpus.

Defined cases: text that is null, empty or has no letter gives ``und`` with score 0; rows without a language are not
learned from; with nothing to learn from every row is ``und``; ties go to the language that sorts first; very long
texts are counted in blocks; repeated rows give repeated results; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, id_text, keep_rows

SYMBOLS = 64
CELLS = SYMBOLS**3
UNKNOWN = "und"
#: Log-likelihood that a further language must gain, for each trigram's logarithm: neighbouring trigrams overlap,
#: so this is larger than the half of the usual criterion.
PENALTY = 6.0
#: Added to each cell's count.
SMOOTHING = 0.05
BLOCK = 1 << 20


def symbol(ch: str) -> int:
    """0 for what isn't a letter, 1 to 26 for a to z, one of 37 more for other letters."""
    low = ord(ch.lower()[0])
    return (low - 96 if 97 <= low <= 122 else 27 + low % 37) if ch.isalpha() else 0


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point (as far as the basic plane) to symbol; 0 is a word break."""
    return np.array([symbol(chr(c)) for c in range(0x10000)], np.uint8)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram cells and their counts; trigrams whose middle is a word break are left out."""
    table, total = symbol_table(), None
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - 2) : at + BLOCK] if at else text[:BLOCK]
        code = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        s = table[np.where(code < 0x10000, code, 0)].astype(np.int32)
        for c in np.unique(code[code >= 0x10000]):  # letters beyond the basic plane
            s[code == c] = symbol(chr(c))
        if not at:
            s = np.concatenate(([0], s))
        if at + BLOCK >= len(text):
            s = np.concatenate((s, [0]))
        g = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        cells, n = np.unique(g[s[1:-1] > 0], return_counts=True)
        if total is not None:
            cells, inv = np.unique(np.concatenate((total[0], cells)), return_inverse=True)
            n = np.bincount(inv, np.concatenate((total[1], n)), cells.size).astype(np.int64)
        total = cells, n
    return total if total else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_trigrams(train: DataFrame) -> DataFrame:
    """(lang, cell, n) over every row of (lang, text); one dense row of counts for each language and task, as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cells, n = trigrams(text.as_py())
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang][cells] += n
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * at.size, pa.string()), "cell": pa.array(at, pa.int32()), "n": v[at]})

    return train.select("lang", "text").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages in order and their trigram probabilities."""

    def __init__(self, langs: list[str], p: np.ndarray):
        self.langs, self.p = langs, p

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, int]]) -> LanguageModel:
        langs = sorted({r[0] for r in rows})
        counts = np.full((len(langs), CELLS), SMOOTHING)
        at = {x: i for i, x in enumerate(langs)}
        for lang, cell, n in rows:
            counts[at[lang], cell] += n
        return cls(langs, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if langs else counts)

    def shares(self, cells: np.ndarray, n: np.ndarray, rounds: int = 25) -> dict[str, float]:
        """The chosen languages and their shares of the document."""
        if not self.langs or not cells.size:
            return {}
        p = self.p[:, cells].astype(np.float64)
        total, single = n.sum(), np.log(p) @ n
        cost = PENALTY * np.log(total + 1.0)

        def fit(rows: list[int]) -> tuple[float, np.ndarray]:
            q, pi = p[rows], np.full(len(rows), 1 / len(rows))
            for _ in range(rounds):
                joint = pi[:, None] * q
                new = (joint / joint.sum(axis=0)) @ n / total
                done = np.abs(new - pi).max() < 1e-3
                pi = new
                if done:
                    break
            return float(np.log(pi @ q) @ n), pi

        chosen, best, pi = [int(single.argmax())], float(single.max()), np.ones(1)
        if len(self.langs) > 1 and fit(list(range(len(self.langs))))[0] - best > cost:  # the whole set bounds what any set can gain
            while len(chosen) < len(self.langs):
                tries = [(*fit([*chosen, k]), k) for k in range(len(self.langs)) if k not in chosen]
                top = max(tries, key=lambda t: t[0])
                if top[0] - best <= cost:
                    break
                best, pi, chosen = top[0], top[1], [*chosen, top[2]]
        return {self.langs[k]: float(s) for k, s in zip(chosen, pi, strict=True)}

    def predict(self, text: str) -> tuple[str, float, str]:
        found = self.shares(*trigrams(text))
        if not found:
            return UNKNOWN, 0.0, ""
        lang = min(found, key=lambda k: (-found[k], k))
        return lang, min(1.0, found[lang]), ",".join(f"{k}:{found[k]:.3f}" for k in sorted(found))


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row with a language; the model (cells x languages) is what comes to the driver."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return LanguageModel.from_counts([(r.lang, r.cell, r.n) for r in count_trigrams(train).collect()])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 64^3 cells

    def make():
        m = shared.value

        def f(x):
            got = [m.predict(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "mixture": [g[2] for g in got]}

        return f

    return arrow_map(id_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double, mixture string")


def language_of(docs: DataFrame) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 4 is not 2, predict all rows."""
    held = fold("doc_id", 4) == 2
    model = train_language_model(docs.where(~held))
    return identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "mixture")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Whole rows whose text has a language; those that are ``und`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda t: m.predict(t or "")[0] != UNKNOWN

    return keep_rows(docs, make)

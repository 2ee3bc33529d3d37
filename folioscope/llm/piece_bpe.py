"""Operator 9, SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type encoding is the one sequence of pieces in which every two neighbours are what merging their joined text
from single characters gives. So: take the longest piece at each place (one Aho-Corasick pass finds them), accept it
if it is compatible with the piece before (found by re-merging the two), else try the next shorter prefix, else step
back; a bitfield marks places from which no encoding goes on, so none is tried twice.

Pieces never hold a space mark behind another character, so a text is encoded run by run ("space marks, then other
characters") and each worker keeps the ids of runs and the verdicts on neighbours, bounded in number. Characters
outside the vocabulary become byte pieces. Decoding is the library's.

Defined cases: null and empty texts are begin and end id alone and decode to ""; repeated rows give repeated results;
a very long run is linear in its length; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, id_text
from .piece_encoder import Kept

MARK = "▁"
RUNS = re.compile(" +[^ ]*")


class PieceModel:
    def __init__(self, path: str, keep: int = 700_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.auto = ahocorasick.Automaton()
        for p in self.ids:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.runs, self.pairs, self.prefixes = Kept(keep, self.run_ids), Kept(keep // 2, self.compatible), Kept(keep // 8, self.shorter)

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by merging: best score first, leftmost of equals."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = scores.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        return self.merged(a + b) == ([a, b] if a else [b])

    def shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece (a single character always counts as one); "" if there is none."""
        for n in range(len(piece) - 1, 1, -1):
            if piece[:n] in self.ids:
                return piece[:n]
        return piece[:1] if len(piece) > 1 else ""

    def backtrack(self, s: str) -> list[str]:
        longest = [1] * len(s)
        for end, n in self.auto.iter(s):
            at = end - n + 1
            if n > longest[at]:
                longest[at] = n
        open_ = bytearray(b"\xff" * (len(s) // 8 + 1))  # a set bit: encoding may go on from here
        out: list[str] = []
        at, piece = 0, s[: longest[0]]
        while at < len(s):
            end, last = at + len(piece), out[-1] if out else ""
            if open_[end >> 3] >> (end & 7) & 1 and self.pairs[last, piece]:
                out.append(piece)
                at = end
                piece = s[at : at + longest[at]] if at < len(s) else ""
                continue
            piece = self.prefixes[piece]
            if not piece:
                open_[at >> 3] &= ~(1 << (at & 7)) & 255
                piece = out.pop()  # every text has an encoding, so there is one to take back
                at -= len(piece)
        return out

    def run_ids(self, s: str) -> bytes:
        """Ids of a run given with spaces for its marks, or without if it has exactly one."""
        s = (MARK + s) if not s.startswith(" ") else s.replace(" ", MARK)
        ids = array("H")
        for p in self.backtrack(s):
            i = self.ids.get(p)
            if i is None:
                ids.extend(self.bytes[b] for b in p.encode())
            else:
                ids.append(i)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids between begin and end id, as little-endian unsigned 16-bit integers."""
        ids = b""
        if text:
            s = text.replace(MARK, " ")
            ids = b"".join(map(self.runs.__getitem__, RUNS.findall(" " + s) if "  " in s or s.startswith(" ") else s.split(" ")))
        return array("H", [self.bos]).tobytes() + ids + array("H", [self.eos]).tobytes()


_models: dict[str, PieceModel] = {}


def shared_model(path: str) -> PieceModel:
    """The worker process's model: what one task has kept serves the next, and is held once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def piece_round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        m = shared_model(model)

        def f(x):
            out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in x["text"]:
                ids = np.frombuffer(m.encode(t), np.uint16)
                out["n_tokens"].append(ids.size)
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(m.library.decode(ids.tolist()).encode()).hexdigest())
            return out

        return f

    return arrow_map(id_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

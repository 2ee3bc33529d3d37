"""Encoding of whole texts with the tokenizers library, cut at white space where the library's own rules cut.

The two vocabularies never join tokens across the cuts used here, so a text's ids are those of its cuts in order.
Cuts repeat, so each worker keeps their ids, at most ``keep`` of them in two generations (memory is bounded); a cut
that isn't kept is encoded by the library. Texts where the cuts would not be safe, those with an added
token's literal among them, go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import releases

#: The white space of the tokenizers' patterns (Unicode's property; Python's \\s has four controls more).
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ODD_SPACE = re.compile(f"[{WS}][{WS}]|[{WS}]$")
LATIN_1 = re.compile(r"[\x00-\xff]*")
CONTROLS = re.compile(r"[\x1c-\x1f]")
NOT_SPACE = re.compile(f"[^{WS}]+")
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſªµº]+| ?[0-9²³¹¼-¾]+| ?[^ \nA-Za-zÀ-ÖØ-öø-ſªµº0-9²³¹¼-¾]+|\n")
#: Latin letters and what stands with them, single line breaks among them, without the capital whose small letter is two characters.
PLAIN_CUT = re.compile(r"[\n\x21-\x7e\xa1-įı-ſ]+")
LETTERS = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+")
LOWER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſªµº]+|[0-9²³¹¼-¾]|[^a-zß-öø-ſªµº0-9²³¹¼-¾]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Longer strings aren't kept, so the size of what is kept is bounded like its number.
LONGEST_KEPT = 64


class Kept(dict):
    """A bounded cache of what ``make`` gives for a key, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, keep: int, make: Callable):
        super().__init__()
        self.keep, self.make, self.old = max(1, keep // 2), make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.keep:
                self.old = self.copy()
                self.clear()
            self[key] = got
        return got

    def near(self, key):
        """What is kept for a key, else what make gives, which isn't kept."""
        return self.get(key) or self.old.get(key) or self.make(key)

    def each(self, keys: list) -> list:
        """What is kept for each key, else what make gives, which is kept. What the old generation has stays there."""
        young, old = self.get, self.old.get
        got = [young(k) or old(k) for k in keys]
        for i, x in enumerate(got):
            if not x:
                got[i] = self[keys[i]]
        return got


#: Cuts whose ids a worker process keeps, in some 200 to 300 bytes each.
KEEP = 300_000


class Encoder:
    """path: a tokenizers file; kind: "byte" (byte-level pieces with their leading space) or "word" (white space dropped)."""

    def __init__(self, path: str, kind: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.kind = kind
        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        #: In any case of letters, as the library may look for a literal in text that it has lower-cased.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        #: What literals begin with before their first letter: a quick test.
        self.marks = {re.match(r"\W*", t).group() for t in added}
        self.tokenize = self.library.model.tokenize
        self.letters = byte_letters()
        self.cuts, self.pieces = Kept(keep, self.cut), Kept(keep // 8, self.by_model)

    def by_library(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def by_model(self, s: str) -> bytes:
        """Ids of a string that the pattern cuts no further, as unsigned 16-bit integers."""
        return array("H", [t.id for t in self.tokenize(s.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def word(self, s: str) -> bytes:
        """Ids of letters alone, which are one piece, without a second entry among the pieces."""
        if s.isascii():
            return array("H", [t.id for t in self.tokenize(s if self.kind == "word" else "\u0120" + s)]).tobytes()
        return self.by_model(s if self.kind == "word" else " " + s)

    def cut(self, s: str) -> bytes:
        """Ids of one cut. Byte-level cuts stand for themselves behind a space; a first cut comes through head()."""
        if s.isalpha() and (s.isascii() or LETTERS.fullmatch(s)):
            return self.word(s.lower() if self.kind == "word" else s)
        if not PLAIN_CUT.fullmatch(s):
            return self.by_library(s if self.kind == "word" else " " + s)
        if s[:-1].isalpha() and s[-1] in ",.;:!?":  # a word's mark is a piece of its own
            return self.cuts.near(s[:-1]) + self.pieces[s[-1]]
        return b"".join(map(self.pieces.__getitem__, LOWER_PIECES.findall(s.lower()) if self.kind == "word" else LATIN_PIECES.findall(" " + s)))

    def head(self, s: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, LATIN_PIECES.findall(s))) if not s or PLAIN_CUT.fullmatch(s) else self.by_library(s)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 16-bit integers."""
        first = b""
        if any(m in text for m in self.marks) and self.added.search(text):
            return self.by_library(text)
        if self.kind == "word":
            if text.isascii() or LATIN_1.fullmatch(text):
                text = text.lower()  # one for one there, so capitals need no entries of their own
            cuts = text.split() if not CONTROLS.search(text) else NOT_SPACE.findall(text)
        else:
            if ODD_SPACE.search(text):
                return self.by_library(text)
            cuts = text.split(" ")
            first = self.head(cuts.pop(0))
        return first + b"".join(map(self.cuts.__getitem__, cuts))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text, where kind is "word": Arrow cuts them and each distinct cut of all of them is looked up once."""
        got, at, plain = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if any(c in t for c in "\x1c\x1d\x1e\x1f") or any(m in t for m in self.marks) and self.added.search(t):
                got[i] = self.encode(t)
            else:
                at.append(i)
                plain.append(t.lower() if t.isascii() or LATIN_1.fullmatch(t) else t)
        if plain:
            lists = pc.utf8_split_whitespace(pa.array(plain, pa.string()))  # with empty cuts at the ends
            cuts = lists.flatten().dictionary_encode()
            distinct = cuts.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = pa.array(self.cuts.each(distinct), pa.large_binary()).take(cuts.indices)
            _, ends, data = ids.buffers()
            if data is not None:
                places = np.frombuffer(ends, np.int64, len(ids) + 1, 8 * ids.offset)[lists.offsets.to_numpy()].tolist()
                for i, start, end in zip(at, places, places[1:], strict=False):
                    got[i] = data.slice(start, end - start).to_pybytes()
        return got


_encoders: dict[tuple[str, str, int], Encoder] = {}
releases.append(_encoders.clear)


def shared_encoder(path: str, kind: str, keep: int = KEEP) -> Encoder:
    """The worker process's encoder: what one task has kept serves the next, and is held once."""
    if (path, kind, keep) not in _encoders:
        _encoders.clear()
        _encoders[path, kind, keep] = Encoder(path, kind, keep)
    return _encoders[path, kind, keep]

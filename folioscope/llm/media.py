"""Operator 1, media columns: texts stored as grey PNG images in a binary column, read back, and hashed.

Rows are 192 samples wide. The encoder picks one of the filters None, Sub and Up for each row (least sum of
absolute differences); the decoder checks every chunk's CRC, inflates the IDAT chunks, and undoes all five filter
types in numpy. The hash is the sign pattern of the 8 x 8 lowest cosine coefficients against their median.

Defined cases: a null or empty text becomes one row of spaces; equal texts give equal images and hashes; repeated
rows give repeated results; an empty table gives an empty one; other columns are not read. Long texts become tall
images: the transform runs over blocks of rows, so memory stays a small multiple of one document.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, id_text, stored

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
LOW = 8
BLOCK_ROWS = 4096


class MediaError(ValueError):
    """An image that isn't intact: wrong signature, checksum, order of chunks, or length."""


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    n = max(width, -(-len(payload) // width) * width)
    return payload.ljust(n, b" ")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(img: np.ndarray) -> np.ndarray:
    """Rows with their filter byte in front."""
    sub, up = img.copy(), img.copy()
    sub[:, 1:] -= img[:, :-1]
    up[1:] -= img[:-1]
    kinds = np.stack([img, sub, up])
    best = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    out = np.empty((img.shape[0], img.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(img.shape[0])]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey image of the payload, whose length must be a positive multiple of width."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = zlib.compress(filtered(img).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, img.shape[0], 8, 0, 0, 0, 0)
    parts = [chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *parts, chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the filters of one-byte pixels; rows have their filter byte in front."""
    kinds, img = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown row filter")
    subs = kinds == 1
    img[subs] = np.cumsum(img[subs], axis=1, dtype=np.uint8)
    prior = np.zeros(img.shape[1], np.uint8)
    for y in np.flatnonzero((kinds != 0) & ~subs):
        row, prior = img[y], img[y - 1] if y else np.zeros_like(img[0])
        if kinds[y] == 2:
            row += prior
            continue
        left, corner = 0, 0
        for x in range(row.size):
            above = int(prior[x])
            if kinds[y] == 3:
                guess = (left + above) >> 1
            else:
                p = left + above - corner
                a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                guess = left if a <= b and a <= c else above if b <= c else corner
            left, corner = (int(row[x]) + guess) & 255, above
            row[x] = left
    return img


def decode_png(png: bytes) -> np.ndarray:
    """The samples, after checking signature, each chunk's CRC, the zlib checksum and the lengths."""
    if png[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise MediaError("cut short")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit grey image")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(parts), bufsize=max(1, height * (width + 1)))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@functools.lru_cache(maxsize=256)
def cosines(n: int, start: int, stop: int) -> np.ndarray:
    y = np.arange(start, stop)
    return np.cos(np.pi * (2 * y[None, :] + 1) * np.arange(LOW)[:, None] / (2 * n))


def cosine_hash(img: np.ndarray) -> bytes:
    """64 bits: which of the lowest coefficients lie above the median of all but the mean."""
    h, w = img.shape
    part = np.zeros((LOW, w))
    for y in range(0, h, BLOCK_ROWS):
        part += cosines(h, y, min(h, y + BLOCK_ROWS)) @ img[y : y + BLOCK_ROWS].astype(np.float64)
    low = (part @ cosines(w, 0, w).T).ravel() / (h * w)
    return np.packbits(np.round(low, 9) > np.median(np.round(low[1:], 9))).tobytes()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the binary column to store."""

    def make():
        def f(x):
            raw = [t.encode() for t in x["text"]]
            return {"doc_id": x["doc_id"], "n_bytes": [len(r) for r in raw], "media": [encode_png(pad(r)) for r in raw]}

        return f

    return arrow_map(id_text(docs, id_col, text_col), make, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode a stored media table and compute digests and the cosine hash from what was read."""

    def make():
        def one(i, n, png):
            img = decode_png(png)
            raw = img.tobytes()
            bits = cosine_hash(img)
            return i, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), bits

        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "cosine_hash")

        def f(x):
            return dict(zip(names, zip(*map(one, x["doc_id"], x["n_bytes"], x["media"])), strict=True)) if x["doc_id"] else dict.fromkeys(names, [])

        return f

    return arrow_map(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cosine_hash binary")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, read the stored table back, return its features."""
    return media_features(stored(encode_media(docs, id_col, text_col), "media", compression="none"))

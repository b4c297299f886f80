"""Texts as grey PNG images in a binary column, and low-frequency cosine hashes of the images read back.

Scale: a projection, a table written between the two steps; no shuffle.

Written: one IHDR, one zlib stream in IDAT chunks, IEND; 8-bit samples, rows of 64, each row filtered by Sub or Up,
whichever has the smaller sum of signed residues. Read: any non-interlaced 8-bit grey PNG with all five row filters;
signature, chunk checksums, zlib checksum and sizes are tested and a fault raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm._shared import bound_batches

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of zlib stream in a chunk.
CHUNK = 1 << 16
SIDE, LOW = 32, 8


def payload(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of WIDTH. A null text is empty."""
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(data: bytes, level: int = 6) -> bytes:
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    cost = lambda r: np.abs(r.view(np.int8).astype(np.int16)).sum(axis=1)
    better = cost(up) < cost(sub)
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0] = np.where(better, 2, 1)
    rows[:, 1:] = np.where(better[:, None], up, sub)
    stream = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", stream[k : k + CHUNK]) for k in range(0, len(stream), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows, the filter's number in column 0. Sub is a sum along a row, runs of Up one down the rows."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    sub = kinds == 1
    data[sub] = np.cumsum(data[sub], axis=1, dtype=np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
        if kinds[first] == 2:
            if first:
                data[first] += data[first - 1]
            data[first:end] = np.cumsum(data[first:end], axis=0, dtype=np.uint8)
        elif kinds[first] > 2:
            for k in range(first, end):
                above = data[k - 1].astype(int) if k else np.zeros(data.shape[1], int)
                left = corner = 0
                for c in range(data.shape[1]):
                    if kinds[k] == 3:
                        guess = (left + above[c]) // 2
                    else:
                        away = [abs(above[c] - corner), abs(left - corner), abs(left + above[c] - 2 * corner)]
                        guess = (left, above[c], corner)[away.index(min(away))]
                    left, corner = (int(data[k, c]) + guess) & 255, above[c]
                    data[k, c] = left
    return data


def read_png(media: bytes) -> np.ndarray:
    """The samples, one row of the array for each row of the image."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, stream, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r}: wrong checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image without interlace")
    try:
        data = zlib.decompress(b"".join(stream))
    except zlib.error as fault:
        raise ValueError(f"zlib: {fault}") from fault
    if len(data) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(data, np.uint8).reshape(head[1], head[0] + 1))


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _averages(n: int) -> np.ndarray:
    """SIDE rows of weights that average n samples over equal stretches, parts of samples included."""
    edges = np.linspace(0, n, SIDE + 1)
    cells = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, 1) * (SIDE / n)


_COS, _ACROSS = _cosines(), _averages(WIDTH)


def cosine_hash(image: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine terms of the image shrunk to 32 x 32 are above their median (the mean term apart)."""
    n = len(image)
    if n >= SIDE and n % SIDE == 0:
        down = image.reshape(SIDE, n // SIDE, -1).mean(axis=1)
    else:
        sums = np.vstack([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
        edges = np.linspace(0, n, SIDE + 1)
        low = np.minimum(edges.astype(int), n - 1)
        at = sums[low] + (edges - low)[:, None] * image[low]
        down = np.diff(at, axis=0) * (SIDE / n)
    across = _ACROSS if image.shape[1] == WIDTH else _averages(image.shape[1])
    low = _COS @ (down @ across.T) @ _COS.T
    terms = np.round(low.ravel(), 6)
    bits = terms > np.median(terms[1:])
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _images(texts: pd.Series) -> pd.Series:
    return pd.Series([write_png(payload(t)) for t in texts], dtype=object)


def _features(media: pd.Series) -> pd.DataFrame:
    out = []
    for one in media:
        image = read_png(bytes(one or b""))
        data = image.tobytes()
        out.append((data, zlib.crc32(data[-WIDTH:]), f"{cosine_hash(image):016x}"))
    return pd.DataFrame(out, columns=["payload", "tail_crc32", "feature"])


IMAGE = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text of each row as a PNG in a binary column. Null and empty texts are an image of one row of zeros.

    A column of docs that is named like `media` gives way to it. Write the rows before with_features() reads them: in
    one plan the images would be made anew for it.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(media, F.pandas_udf(_images, T.BinaryType())(F.col(text)))


def with_features(media_rows: DataFrame, media: str = "media", image: str = "image") -> DataFrame:
    """Adds the struct `image`: payload read back, crc32 of its last 64 bytes, cosine hash as 16 hex digits.

    A damaged image raises; a null one does, too. A column of media_rows that is named like `image` gives way to it.
    """
    bound_batches(media_rows.sparkSession)
    return media_rows.withColumn(image, F.pandas_udf(_features, IMAGE)(F.col(media)))

"""Media columns: texts as PNG images in binary columns, checked on the way back, with low-frequency hashes.

The payload of a text is its UTF-8 bytes (null: none) with bytes 0 up to a positive multiple of 64. It becomes an 8-bit
grey image of 64 columns. Reading walks the chunks, tests each checksum, inflates the data and undoes the row filters
with numpy, then hashes the low frequencies of the cosine transform of the image.

Equal texts give equal images and hashes; a text of any length is one image. A binary value that is null or not an intact
8-bit PNG gives `ok` false and nulls, never an exception. Repeated rows are read each. Other columns of the input are kept as
they are, but for those that are named like the two new ones: they are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
# Fixed values of the PNG format: signature, and channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

FEATURES = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("phash", T.BinaryType()),
])


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey PNG of 64 columns. Each row takes the filter (none, sub, up) of least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    ways = np.empty((3, *rows.shape), np.uint8)
    ways[0] = rows
    ways[1] = rows
    ways[1, :, 1:] -= rows[:, :-1]
    ways[2] = rows
    ways[2, 1:] -= rows[:-1]
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    out = np.empty((len(rows), WIDTH + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = ways[kind, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five row filters; raw has the filter number in its first column."""
    kinds, data = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    sub = kinds == 1
    if sub.any():  # along the row, each channel by itself
        part = data[sub].reshape(int(sub.sum()), -1, bpp)
        data[sub] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(part.shape[0], -1)
    edges = np.flatnonzero(np.diff(kinds, prepend=255))
    for start, end in zip(edges, [*edges[1:], len(kinds)]):
        kind = kinds[start]
        if kind == 2:  # a run of rows that add up downwards
            first = max(start - 1, 0) if start else 0
            data[first:end] = np.cumsum(data[first:end], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(start, end):
                above = data[y - 1] if y else np.zeros_like(data[0])
                _unfilter_row(data[y], above, bpp, kind)
    return data


def _unfilter_row(row: np.ndarray, above: np.ndarray, bpp: int, kind: int) -> None:
    line, up = row.tolist(), above.tolist()
    for x in range(len(line)):
        a, b = line[x - bpp] if x >= bpp else 0, up[x]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[x - bpp] if x >= bpp else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        line[x] = (line[x] + guess) & 255
    row[:] = line


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a non-interlaced 8-bit PNG as (rows, columns * channels); ValueError if anything is amiss."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("checksum differs")
        if kind == b"IHDR":
            if len(body) != 13 or head is not None:
                raise ValueError("not one head of 13 bytes")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not a whole 8-bit image")
    if not head[0] or not head[1]:
        raise ValueError("an image without samples")
    bpp = CHANNELS[head[3]]
    size, unpacker = head[1] * (head[0] * bpp + 1), zlib.decompressobj()
    try:  # no more is unpacked than the head says, whatever is packed
        raw = np.frombuffer(unpacker.decompress(b"".join(packed), min(size + 1, sys.maxsize)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if raw.size != size or not unpacker.eof:
        raise ValueError("wrong amount of data")
    return unfilter(raw.reshape(head[1], -1), bpp)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(k)[:, None] / n)


_SIDE, _LOW = 32, 8
_BASIS = _cosines(_SIDE, _LOW)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: the 8 x 8 lowest frequencies of the image at 32 x 32, each against their median (the mean left out)."""
    rows = np.linspace(0, image.shape[0], _SIDE + 1).astype(np.int64)[:-1]
    cols = np.linspace(0, image.shape[1], _SIDE + 1).astype(np.int64)[:-1]
    grown = [np.maximum(np.diff([*edge, n]), 1) for edge, n in ((rows, image.shape[0]), (cols, image.shape[1]))]
    small = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.float64), cols, axis=1)
    small /= grown[0][:, None] * grown[1]
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


@F.pandas_udf(T.BinaryType())
def png_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode_png(payload_of(t)))


@F.pandas_udf(FEATURES)
def features_of(images: pd.Series) -> pd.DataFrame:
    out = []
    for data in images:
        try:
            if data is None:
                raise ValueError("null")
            image = decode_png(bytes(data))
        except ValueError:
            out.append((False, None, None, None, None, None, None, None, None))
            continue
        payload = image.tobytes()
        out.append((
            True, image.shape[1], image.shape[0], len(payload), hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image),
        ))
    return pd.DataFrame(out, columns=FEATURES.names, dtype=object)


def media_columns(df: DataFrame, text: str = "text", media: str = "media", features: str = "features") -> DataFrame:
    """df with the image of each text in a binary column and, read back from it, a struct of features."""
    return df.withColumn(media, png_of(text)).withColumn(features, features_of(media))


def hex_of(column: Column | str) -> Column:
    return F.lower(F.hex(column))

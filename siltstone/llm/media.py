"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral
images and written as NPY tiles with difference hashes.

decode_image() reads P1 to P6 (8 or 16 bits) and uncompressed BMP of 8, 24 or 32 bits;
tile() shrinks by the mean over exact, also fractional, source areas, from one integral
image; difference_hash() holds whether brightness rises from one cell to the next.

text_payload_images() is the lossless column form for documents: the text's UTF-8 bytes,
padded with 0 to a positive multiple of 64, are the samples of a 64 pixel wide grey
image, stored as PGM or as BMP, as the caller says. Everything else comes from the stored
bytes as read back.

Edge cases: a null or empty text is one row of zeros; images that cannot be read raise
ValueError; an empty table gives an empty result; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WIDTH = 64
TILE = 16


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    values, at = [], 2
    while len(values) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) % (len(data) + 1)) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        values.append(int(data[at:end]))
        at = end
    return values, at


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, colour = kind in (1, 4), kind in (3, 6)
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = head[:2]
    shape = (height, width, 3) if colour else (height, width)
    count = int(np.prod(shape))
    if kind <= 3:
        body = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        flat = np.array([c - 48 for c in body if c in b"01"] if bitmap else [int(x) for x in body.split()], np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, offset=at + 1, count=height * ((width + 7) // 8)).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if head[2] > 255 else np.uint8, offset=at + 1, count=count)
    if len(flat) < count:
        raise ValueError("a Netpbm image ends early")
    image = flat[:count].reshape(shape)
    if bitmap:
        return np.where(image > 0, 0, 255).astype(np.uint8)  # 1 is black
    return image.astype(np.uint16 if head[2] > 255 else np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("only plain BMP of 8, 24 or 32 bits")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, offset=start, count=stride * abs(height)).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        table = np.frombuffer(data, np.uint8, offset=14 + head, count=(start - 14 - head) // 4 * 4).reshape(-1, 4)
        pixels = table[rows[:, :width]][..., 2::-1]
        grey = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
        return np.ascontiguousarray(pixels[..., 0] if grey else pixels)
    return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1])


def decode_image(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP image: (rows, columns) or (rows, columns, 3)."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


_GREYS = bytes(b for v in range(256) for b in (v, v, v, 0))


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey BMP; rows from the bottom up, padded to four bytes."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = image[::-1]
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0) + _GREYS + body.tobytes()


def tile(image: np.ndarray, height: int = TILE, width: int = TILE) -> np.ndarray:
    """Area means: cell (i, j) is the mean over its exact part of the source, read off an
    integral image at fractional corners."""
    if image.ndim == 3:
        image = image.mean(axis=2)
    rows, cols = image.shape
    total = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    y, x = np.arange(height + 1) * rows / height, np.arange(width + 1) * cols / width
    yi, xi = np.minimum(y.astype(int), rows - 1), np.minimum(x.astype(int), cols - 1)
    up = total[yi] + (y - yi)[:, None] * (total[yi + 1] - total[yi])
    corners = up[:, xi] + (x - xi) * (up[:, xi + 1] - up[:, xi])
    area = (rows / height) * (cols / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hexadecimal: whether each cell of an 8 by 9 tile is darker than the next."""
    small = tile(image, 8, 9)
    return np.packbits(np.round(small[:, 1:], 6) > np.round(small[:, :-1], 6)).tobytes().hex()


def text_image(text: bytes, form: str = "pgm") -> bytes:
    """The stored form of a text, pgm or bmp: a grey image whose samples are its padded bytes."""
    rows = max(1, -(-len(text) // WIDTH))
    image = np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    return {"pgm": encode_pgm, "bmp": encode_bmp}[form](image)


def image_text(stored: bytes, n_bytes: int) -> bytes:
    return decode_image(stored).tobytes()[:n_bytes]


def text_payload_images(docs: DataFrame, tiles: bool = True, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, and of the stored image: media (its bytes) and tile (NPY) if
    `tiles`, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dhash. The
    stored form is `form` for all texts."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string"
    schema += ", media binary, tile binary" if tiles else ""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema.split(", ")]
            size = 0
            ids = batch.column(0)
            done = 0
            for k, cell in enumerate(batch.column(1)):
                text = cell.as_py() or b""
                stored = text_image(text, form)
                image = decode_image(stored)
                payload = image.tobytes()
                row = [len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image)]
                row += [stored, npy_bytes(tile(image).round().astype(np.uint8))] if tiles else []
                for column, value in zip(out[1:], row, strict=True):
                    column.append(value)
                size += len(stored) if tiles else 0
                if size > 1 << 24 or k + 1 == len(batch):  # no more than some MB at once
                    yield _batch(ids.slice(done, k + 1 - done), out[1:], schema)
                    out, size, done = [[] for _ in out], 0, k + 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(lean(images), schema)


def _batch(ids: pa.Array, columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, kinds[t]) for c, t in zip(columns, types[1:], strict=True)]], list(names))

"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, NPY tiles and difference hashes.

Images are binary columns.  ``decode`` reads P1-P6 and uncompressed 24-bit BMP; ``area_resize`` averages exact (fractional)
areas by an integral image; ``npy_bytes`` writes a tile in NPY format; ``difference_hash`` compares neighbouring cells.

Defined cases: a null or undecodable image gives nulls and an ``error``; equal images give equal results.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
ROW = 192


def encode_ppm(pixels: np.ndarray) -> bytes:
    """An (h, w, 3) or (h, w) uint8 array as P6 or P5."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An (h, w, 3) uint8 array as an uncompressed 24-bit BMP: rows from the bottom, BGR, padded to four bytes."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The (h, w, 3) or (h, w) uint8 array of a Netpbm or BMP image; ValueError if it is neither or is cut off."""
    if blob[:2] == b"BM":
        start, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", blob)
        if bits != 24 or packed or size < 40 or w <= 0 or not h:
            raise ValueError("only uncompressed 24-bit BMP")
        stride, up = (3 * w + 3) // 4 * 4, h > 0
        rows = np.frombuffer(blob, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : 3 * w].reshape(abs(h), w, 3)
        return (rows[::-1] if up else rows)[:, :, ::-1]
    if not re.match(rb"P[1-6][\s#]", blob[:3]):
        raise ValueError("neither Netpbm nor BMP")
    kind, at, head = int(blob[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(blob, at)
        if not m or not re.fullmatch(rb"[0-9]{1,9}", m[1]):
            raise ValueError("cut off, or not a size")
        head.append(int(m[1]))
        at = m.end()
    (w, h), top = head[:2], (head + [1])[2]
    if w <= 0 or h <= 0 or not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    depth = 3 if kind in (3, 6) else 1
    if len(blob) < (w + 7) // 8 * h:
        raise ValueError("cut off")
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind >= 5:
        flat = np.frombuffer(blob, np.uint8, w * h * depth, at + 1)
    elif kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", blob[at:])[: w * h], np.uint8) - np.uint8(48)
        if (flat > 1).any():
            raise ValueError("a bit that is neither 0 nor 1")
        flat = 1 - flat
    else:
        words = re.sub(rb"#[^\n]*", b"", blob[at:]).split()[: w * h * depth]
        if not all(re.fullmatch(rb"0*[0-9]{1,3}", x) for x in words):
            raise ValueError("not a sample")
        flat = np.array(words, dtype=np.int64)
    if flat.size < w * h * depth:
        raise ValueError("cut off")
    if kind != 1 and flat.size and flat.max() > top:
        raise ValueError("a sample above the maximum")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 // top).astype(np.uint8)
    return flat.astype(np.uint8, copy=False).reshape((h, w, 3) if depth == 3 else (h, w))


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The means of height x width equal areas (float64); cells that cut pixels take their share of them."""
    body = pixels.reshape(*pixels.shape[:2], -1)
    h, w, c = body.shape
    whole = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(body, axis=0, dtype=np.int64), axis=1, out=whole[1:, 1:])

    def cut(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        size = a.shape[axis] - 1
        at = np.arange(n + 1) * (size / n)
        low = np.minimum(at.astype(np.int64), size - 1)
        share = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        first = a.take(low, axis)
        return np.diff(first + (a.take(low + 1, axis) - first) * share, axis=axis)

    out = cut(cut(whole, height, 0), width, 1) / ((h / height) * (w / width))
    return out.reshape(height, width, *pixels.shape[2:])


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """side * side bits in hex: is a cell of the grey image brighter than its left neighbour?"""
    cells = area_resize(pixels, side, side + 1)
    grey = cells if cells.ndim == 2 else cells @ np.array([0.299, 0.587, 0.114])
    return np.packbits(grey[:, 1:] > grey[:, :-1] + 1e-9).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tiles(images: DataFrame, id_col: str, image_col: str, side: int = 32) -> DataFrame:
    """id, width, height, npy (side x side uint8 tile in NPY format), dhash, error of each image."""
    out = "id long, width int, height int, npy binary, dhash string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    px = decode(blob)
                    rows.append((i, px.shape[1], px.shape[0], npy_bytes(np.rint(area_resize(px, side, side)).astype(np.uint8)), difference_hash(px), None))
                except (ValueError, TypeError, OverflowError, MemoryError, struct.error) as e:
                    rows.append((i, None, None, None, None, str(e)[:200]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "width", "height", "npy", "dhash", "error"])

    return images.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{image_col}`").alias("image")).mapInArrow(run, out)


def write_tiles(images: DataFrame, id_col: str, image_col: str, path: str, side: int = 32) -> None:
    """The tiles as a Parquet table of NPY values, in any file system that Spark can write."""
    tiles(images, id_col, image_col, side).write.parquet(path)


def store_payload(payload: bytes, form: str = "ppm") -> bytes:
    """The payload (a positive multiple of 192 bytes) as an image of 64 pixels by so many rows."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return encode_ppm(px) if form == "ppm" else encode_bmp(px)


def payload_images(docs: DataFrame, form: str = "ppm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text (null: empty) stored as an image and read back: digests of what was read, of the stored form, and features.

    feature: the difference hash and the CRC of a 16 x 16 NPY tile, so both are functions of the decoded pixels.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(i: int, text: str) -> tuple:
        raw = text.encode("utf-8", "replace")
        media = store_payload(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), form)
        px = decode(media)
        back = px.tobytes()
        tile = npy_bytes(np.rint(area_resize(px, 16, 16)).astype(np.uint8))
        return (i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(px)}:{zlib.crc32(tile):08x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return shared.texts(docs, id_col, text_col).mapInArrow(run, schema)

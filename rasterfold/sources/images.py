"""Image files: bytes to pixel rows and back, one file a row, spread by Spark's binary source.

Supported are PNM (P5, P6), PNG (8 bits, not interlaced), BMP (24 and 32 bits), TGA (24 and 32
bits, plain) and QOI. A file's pixels are an array of height x width x 4 in the task that has it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _rgba(channels: np.ndarray) -> np.ndarray:
    """Gray, gray and alpha, RGB or RGBA as RGBA."""
    h, w, n = channels.shape
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = channels[:, :, :1] if n < 3 else channels[:, :, :3]
    if n in (2, 4):
        out[:, :, 3] = channels[:, :, -1]
    return out


def encode_pnm(px: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px[:, :, :3].tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        end = at
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
        elif data[at : at + 1].isspace():
            at += 1
        else:
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(data[at:end])
            at = end
    n, w, h = {b"P5": 1, b"P6": 3}[fields[0]], int(fields[1]), int(fields[2])
    return _rgba(np.frombuffer(data, np.uint8, h * w * n, at + 1).reshape(h, w, n))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = px.reshape(h, -1)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", ()
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    w, h, bits, color, _, _, interlaced = head
    if bits != 8 or interlaced or color not in (0, 2, 4, 6):
        raise ValueError("only PNG files of 8 bits a channel, without palette or interlacing, are read")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + n * w)
    out = np.zeros((h + 1, w + 1, n), np.int64)  # a row above and a pixel to the left, all zero
    for y in range(h):
        line, kind = raw[y, 1:].reshape(w, n).astype(np.int64), raw[y, 0]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = (line + out[y, 1:]) % 256
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) % 256
        else:
            for x in range(w):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y + 1, x + 1] = (line[x] + guess) % 256
    return _rgba(out[1:, 1:].astype(np.uint8))


def encode_bmp(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    body = px[::-1, :, [2, 1, 0, 3]].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 32, 0, len(body), 2835, 2835, 0, 0) + body


def decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack("<I", data[10:14])[0]
    w, h, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("only plain BMP files of 24 or 32 bits are read")
    n = bits // 8
    stride = (w * n + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    rows = rows[::-1] if h > 0 else rows
    return _rgba(rows[:, :, [2, 1, 0, 3][:n]])


def encode_tga(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 32, 0x28) + px[:, :, [2, 1, 0, 3]].tobytes()


def decode_tga(data: bytes) -> np.ndarray:
    skip, _, kind, _, _, _, _, _, w, h, bits, how = struct.unpack("<BBBHHBHHHHBB", data[:18])
    if kind != 2 or bits not in (24, 32):
        raise ValueError("only plain TGA files of 24 or 32 bits are read")
    n = bits // 8
    rows = np.frombuffer(data, np.uint8, h * w * n, 18 + skip).reshape(h, w, n)
    return _rgba((rows if how & 0x20 else rows[::-1])[:, :, [2, 1, 0, 3][:n]])


def encode_qoi(px: np.ndarray) -> bytes:
    """Runs and plain pixels: valid, if not the smallest, QOI."""
    h, w = px.shape[:2]
    flat = px.reshape(-1, 4)
    change = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]).any(1), True])
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, 4, 0))
    for a, b in zip(change, change[1:], strict=False):
        out += b"\xff" + flat[a].tobytes()
        again = int(b - a) - 1
        while again:
            out.append(0xC0 | (min(again, 62) - 1))
            again -= min(again, 62)
    return bytes(out) + b"\0" * 7 + b"\1"


def decode_qoi(data: bytes) -> np.ndarray:
    _, w, h, _, _ = struct.unpack(">4sIIBB", data[:14])
    out, seen, pixel, at = np.zeros((h * w, 4), np.uint8), np.zeros((64, 4), np.uint8), (0, 0, 0, 255), 14
    k = 0
    while k < h * w:
        tag, times = data[at], 1
        at += 1
        if tag == 0xFE:
            pixel = (*data[at : at + 3], pixel[3])
            at += 3
        elif tag == 0xFF:
            pixel = tuple(data[at : at + 4])
            at += 4
        elif tag < 0x40:
            pixel = tuple(seen[tag].tolist())
        elif tag < 0x80:
            pixel = (*((pixel[i] + (tag >> s & 3) - 2) % 256 for i, s in enumerate((4, 2, 0))), pixel[3])
        elif tag < 0xC0:
            green, rest = (tag & 63) - 32, data[at]
            at += 1
            pixel = ((pixel[0] + green - 8 + (rest >> 4)) % 256, (pixel[1] + green) % 256, (pixel[2] + green - 8 + (rest & 15)) % 256, pixel[3])
        else:
            times = (tag & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out[k : k + times] = pixel
        k += times
    return out.reshape(h, w, 4)


ENCODERS = {"pnm": encode_pnm, "png": encode_png, "bmp": encode_bmp, "tga": encode_tga, "qoi": encode_qoi}


def decode(data: bytes) -> np.ndarray:
    """By the first bytes; TGA, which has no mark, is tried last."""
    for mark, reader in ((b"P5", decode_pnm), (b"P6", decode_pnm), (_SIGNATURE, decode_png), (b"BM", decode_bmp), (b"qoif", decode_qoi)):
        if data.startswith(mark):
            return reader(data)
    return decode_tga(data)


def encoded(px: DataFrame, kind: str) -> DataFrame:
    """image_id, content: a file of each image of px (image_id, y, x, r, g, b, a)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1, 4), np.uint8)
        image[rows["y"], rows["x"]] = rows[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "content": [ENCODERS[kind](image)]})

    return px.groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """Pixel rows of files (image_id, content)."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, content in zip(batch["image_id"], batch["content"], strict=True):
                image = decode(bytes(content))
                y, x = np.indices(image.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"image_id": image_id, "y": y, "x": x, **dict(zip("rgba", image.reshape(-1, 4).T, strict=True))})

    return files.select("image_id", "content").mapInPandas(pixels, PIXELS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of all files under a path, numbered by a hash of their own paths."""
    return decoded(spark.read.format("binaryFile").load(path).selectExpr("xxhash64(path) AS image_id", "content"))


#: How files begin (in hexadecimal), and the endings of their names.
BEGINNINGS = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "474946383", "bmp": "424D", "qoi": "716F6966", "webp": "52494646[0-9A-F]{8}57454250", "tiff": "(49492A00|4D4D002A)", "pnm": "503[1-7](0[9A-D]|20|23)", "ico": "00000[12]00"}
ENDINGS = {"png": "png apng", "jpeg": "jpg jpeg jpe jfif", "gif": "gif", "bmp": "bmp dib", "qoi": "qoi", "webp": "webp", "tiff": "tif tiff", "pnm": "pbm pgm ppm pnm pam", "ico": "ico cur", "tga": "tga"}


def _number(content: Column, at: int, size: int, little: bool) -> Column:
    """An unsigned number of some bytes from a place (from 0) of a binary column."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long")
    return sum((byte(k) * 256 ** (k if little else size - 1 - k) for k in range(size)), F.lit(0).cast("long"))


def format_for_path(path: str = "path") -> Column:
    """The format that the ending of a name says, null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(ending.isin(*names.split()), kind) for kind, names in ENDINGS.items()))


def identify(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, width and height from the first bytes of their content, without decoding: expressions only.

    The size is told for PNG, GIF, BMP, QOI and PNM (null for others), and for TGA by its name's
    ending, as it has no mark of its own (some of its files begin as cursors do).
    """
    c = F.col(content)
    head = F.hex(F.substring(c, 1, 16))
    told = F.coalesce(*(F.when(head.rlike(f"^{mark}"), kind) for kind, mark in BEGINNINGS.items()))
    by_name = F.when((format_for_path() == "tga") & (told.isNull() | (told == "ico")), "tga") if "path" in files.columns else F.lit(None)
    found = files.withColumn("format", F.coalesce(by_name, told))
    words = F.filter(F.split(F.regexp_replace(F.substring(c, 1, 512).cast("string"), "#[^\n]*\n", " "), r"\s+"), lambda w: w != "")
    is_kind = lambda k: F.col("format") == k
    pnm = lambda k: F.when(is_kind("pnm") & ~head.rlike("^5037"), F.try_element_at(words, F.lit(k)).try_cast("long"))
    at = {"png": (16, 20, 4, False), "gif": (6, 8, 2, True), "qoi": (4, 8, 4, False), "tga": (12, 14, 2, True)}
    side = lambda n: F.coalesce(*(F.when(is_kind(k), _number(c, v[n], v[2], v[3])) for k, v in at.items()), F.when(is_kind("bmp"), F.abs(_signed(c, 18 + 4 * n))), pnm(2 + n))
    return found.withColumns({"width": side(0), "height": side(1)})


def _signed(content: Column, at: int) -> Column:
    """A signed number of four bytes, the lowest first."""
    value = _number(content, at, 4, True)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)

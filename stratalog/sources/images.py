"""Perceptual hashes of decoded images, with our own bit layout.

Input rows are those of Spark's image source (height, width, nChannels, data in BGR order). An image is
turned to grey and averaged down to a small grid; `phash` compares neighbours along both axes, `dhash` along
rows, `ahash` each cell with the mean; bits go row by row into 64-bit words, the first bit highest.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stratalog.operators import filters

KINDS = ("phash", "dhash", "ahash")


def grid(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of grey over height x width cells of as equal size as can be."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    edge = lambda n, k: (np.arange(k) * n // k, np.maximum(np.arange(1, k + 1) * n // k, np.arange(k) * n // k + 1))
    (a, b), (c, d) = edge(grey.shape[0], height), edge(grey.shape[1], width)
    sums = total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]
    return sums / ((b - a)[:, None] * (d - c)[None])


def signature(grey: np.ndarray, kind: str = "phash", side: int = 16) -> np.ndarray:
    """side * side bits as words; an unknown kind counts as phash."""
    side = max(side, 4)
    if kind == "ahash":
        g = grid(grey, side, side)
        bits = g > g.mean()
    elif kind == "dhash":
        g = grid(grey, side, side + 1)
        bits = g[:, 1:] > g[:, :-1]
    else:
        half = side // 2
        rows, columns = grid(grey, half, side + 1), grid(grey, side - half + 1, side)
        bits = np.concatenate([rows[:, 1:] > rows[:, :-1], columns[1:] > columns[:-1]])
    flat = bits.reshape(-1)
    flat = np.append(flat, np.zeros(-len(flat) % 64, bool))
    return np.packbits(flat).view(">u8").astype(np.int64)


def encoded(words: list[int]) -> str:
    return base64.b64encode(np.array(words, np.int64).astype(">i8").tobytes()).decode()


def decoded(text: str) -> list[int]:
    """ValueError for what isn't an encoded hash."""
    raw = base64.b64decode(text, validate=True)
    if not raw or len(raw) % 8:
        raise ValueError("not a hash")
    return np.frombuffer(raw, ">i8").astype(np.int64).tolist()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Images below path as (path, height, width, n_channels, data); what can't be decoded is left out."""
    own = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return own.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def hashed(images: DataFrame, kind: str = "phash", side: int = 16, least_width: int = 0, least_height: int = 0) -> DataFrame:
    """images with words, without data; too small ones are dropped before the pixels reach Python."""
    kept = images.filter(filters.large_enough(F.col("width"), F.col("height"), least_width, least_height))
    rest = [c for c in images.columns if c != "data"]
    kinds = ", ".join(f"`{k}` {t}" for k, t in images.dtypes if k != "data")

    def run(frames):
        for f in frames:
            words = []
            for h, w, n, data in zip(f.height, f.width, f.n_channels, f.data):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)
                grey = px[:, :, 0] if n == 1 else px[:, :, :3] @ np.array([0.114, 0.587, 0.299])
                words.append(signature(grey, kind, side).tolist())
            yield f[rest].assign(words=pd.Series(words, f.index, dtype=object))

    return kept.mapInPandas(run, f"{kinds}, words array<bigint>")


_HEADER = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType())])


def header_of(head: bytes) -> tuple[int, int, str] | None:
    """Width, height and format by the first bytes of a file, whatever its name; None where they tell no image."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
            return (*struct.unpack(">II", head[16:24]), "png")
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", head[6:10]), "gif")
        if head[:2] == b"BM":
            width, height = struct.unpack("<ii", head[18:26])
            return width, abs(height), "bmp"  # a negative height says that rows go down
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            if head[12:16] == b"VP8X":
                return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little"), "webp"
            if head[12:16] == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "webp"
            width, height = struct.unpack("<HH", head[26:30])
            return width & 0x3FFF, height & 0x3FFF, "webp"
        if head[:2] == b"\xff\xd8":
            at = 2
            while head[at] == 0xFF:
                kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame, not a table
                    height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                    return width, height, "jpeg"
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


@pandas_udf(_HEADER)
def header(head: pd.Series) -> pd.DataFrame:
    """header_of() of the first bytes; nothing is decoded."""
    return pd.DataFrame([header_of(h) or (None, None, None) if h is not None else (None, None, None) for h in head], columns=["width", "height", "format"]).astype({"width": "Int32", "height": "Int32"})


def headers(files: DataFrame, path_col: str = "path", kib: int = 64) -> DataFrame:
    """files on a mounted file system with width, height and format; only the first kib KiB of each are read."""

    def run(frames):
        for f in frames:
            found = []
            for p in f[path_col]:
                try:
                    with open(p, "rb") as s:
                        found.append(header_of(s.read(kib * 1024)) or (None, None, None))
                except OSError:
                    found.append((None, None, None))
            more = pd.DataFrame(found, columns=["width", "height", "format"], index=f.index).astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([f, more], axis=1)

    kinds = ", ".join(f"`{k}` {t}" for k, t in files.dtypes)
    return files.mapInPandas(run, f"{kinds}, width int, height int, format string")

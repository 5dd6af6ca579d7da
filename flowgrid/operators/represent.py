"""Deterministic representations of correlation matrices: bands, digests and rendered images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions.scalar import band
from flowgrid.sources.scratch import stable

BANDS = 21
SIDE = 224


def band_hash(entries: list[str], bands: int = BANDS) -> Column:
    """SHA-256 of the bands that a matrix's entries fall into, after rounding."""
    return F.sha2(F.concat_ws(",", *[band(F.round(F.col(e), 9), bands).cast("string") for e in entries]), 256)


def matrix_hash(corr: Column | str, digits: int | None = None) -> Column:
    """SHA-256 of a matrix's entries (an array), in their order; both zeros are one. Entries are exact,
    or rounded to ``digits``."""
    corr = F.col(corr) if isinstance(corr, str) else corr
    exact = lambda x: (x + F.lit(0.0).cast("float")).cast("string")
    near = lambda x: F.round(x.cast("double") * 10**digits).cast("long").cast("string")
    return F.sha2(F.array_join(F.transform(corr, exact if digits is None else near), ",", "null"), 256)


def without_feature(corr: Column | str, n: int, feature: int) -> Column:
    """A square matrix, row by row, with one feature's row and column zero."""
    corr = F.col(corr) if isinstance(corr, str) else corr
    return F.transform(corr, lambda x, k: F.when((F.floor(k / n) == feature) | (k % n == feature), F.lit(0.0).cast("float")).otherwise(x))


def representation_audit(matrices: DataFrame, n: int, feature: int | None = None, corr: str = "corr", split: str = "split", digits: int | None = None) -> DataFrame:
    """(view, split, windows, distinct_hashes, distinct_ratio, largest_group, matches_train,
    diagonal_one, diagonal_zero): how often matrices repeat within train and validation, and how many
    windows of a part have a matrix that train has.

    View ``full`` has the matrices as they are; with ``feature``, view ``neutral`` has its row and
    column zero, and the diagonal counts are of its own entry. Multisets are compared by the counts of
    their hashes; test windows aren't read.
    """
    given = matrices.filter(F.col(split).isin("train", "validation"))
    views = [("full", F.col(corr))] + ([] if feature is None else [("neutral", without_feature(corr, n, feature))])
    own = F.lit(None).cast("float") if feature is None else F.get(F.col(corr), F.lit(feature * (n + 1)))
    each = given.select(F.col(split).alias("split"), own.alias("own"), F.explode(F.array(*[F.struct(F.lit(name).alias("view"), matrix_hash(c, digits).alias("hash")) for name, c in views])).alias("v")).select("split", "own", "v.*")
    groups = each.groupBy("view", "hash", "split").agg(F.count("*").alias("n"), F.count_if(F.col("own") == 1).alias("one"), F.count_if(F.col("own") == 0).alias("zero"))
    train = F.sum(F.when(F.col("split") == "train", F.col("n"))).over(Window.partitionBy("view", "hash"))  # two rows a group
    return groups.withColumn("_train", F.coalesce(train, F.lit(0))).groupBy("view", "split").agg(
        F.sum("n").alias("windows"),
        F.count("*").alias("distinct_hashes"),
        (F.count("*") / F.sum("n")).alias("distinct_ratio"),
        F.max("n").alias("largest_group"),
        F.sum(F.when(F.col("_train") > 0, F.col("n")).otherwise(0)).alias("matches_train"),
        F.sum("one").alias("diagonal_one"),
        F.sum("zero").alias("diagonal_zero"),
    )


def hash_repetition(items: DataFrame, by: str = "hash", split: str = "split") -> DataFrame:
    """Distinct hashes, items, their ratio and the largest group in each part."""
    return items.groupBy(split, by).agg(F.count("*").alias("n")).groupBy(split).agg(F.count("*").alias("distinct_hashes"), F.sum("n").alias("items"), F.max("n").alias("largest"), (F.count("*") / F.sum("n")).alias("distinct_ratio"))


@lru_cache(maxsize=4)
def _palette(bands: int) -> np.ndarray:
    """Blue over white to red, one colour a band."""
    t = np.linspace(-1, 1, bands)[:, None]
    cold, mid, warm = np.array([[59, 76, 192]]), np.array([[221, 221, 221]]), np.array([[180, 4, 38]])
    return np.rint(np.where(t < 0, mid + (cold - mid) * -t, mid + (warm - mid) * t)).astype(np.uint8)


def raster(matrix: np.ndarray, side: int = SIDE, bands: int = BANDS) -> np.ndarray:
    """Filled contours of a square matrix as side x side x 3 bytes: bilinear between entries."""
    n = len(matrix)
    at = np.linspace(0, n - 1, side)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    part = at - low
    up = np.minimum(low + 1, n - 1)
    rows = matrix[low] * (1 - part)[:, None] + matrix[up] * part[:, None]
    field = rows[:, low] * (1 - part) + rows[:, up] * part
    levels = np.clip(np.floor((np.round(field, 9) + 1) * (bands / 2)), 0, bands - 1).astype(int)
    return _palette(bands)[levels]


def png(pixels: np.ndarray, level: int = 3) -> bytes:
    """A true-colour PNG with unfiltered rows; the same pixels give the same bytes."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def pixels_of(image: bytes) -> np.ndarray:
    """The pixels of an image that png() wrote."""
    at, body, size = 8, b"", (0, 0)
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IHDR":
            size = struct.unpack(">II", image[at + 8 : at + 16])
        elif kind == b"IDAT":
            body += image[at + 8 : at + 8 + n]
        at += 12 + n
    w, h = size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def model_input(image: bytes) -> np.ndarray:
    """Channels first, in [0, 1]."""
    return pixels_of(image).transpose(2, 0, 1).astype(np.float32) / 255.0


def render_distinct(items: DataFrame, key: str, corr: str = "corr") -> tuple[DataFrame, DataFrame]:
    """(key, digest) of each item's square matrix (array<float>, row by row), and (digest, png,
    png_sha256) of each distinct matrix, rendered once. Digests are written once; both read them."""
    keyed = stable(items.select(key, F.sha2(F.array_join(F.transform(corr, lambda x: F.round(x.cast("double"), 6).cast("string")), ","), 256).alias("digest"), F.col(corr).alias("_corr")))
    distinct = keyed.groupBy("digest").agg(F.first("_corr").alias("corr"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            side = lambda v: int(len(v) ** 0.5)
            yield pd.DataFrame({"digest": part["digest"], "png": [png(raster(np.asarray(v, np.float64).reshape(side(v), side(v)))) for v in part["corr"]]})

    images = distinct.mapInPandas(run, "digest string, png binary").withColumn("png_sha256", F.sha2("png", 256))
    return keyed.select(key, "digest"), images


def render(items: DataFrame, key: str, corr: str = "corr") -> DataFrame:
    """(key, png, png_sha256) of each item's matrix; equal matrices are rendered once."""
    names, images = render_distinct(items, key, corr)
    return names.join(images, "digest").select(key, "png", "png_sha256")


def image_index(images: DataFrame, items: DataFrame, key: str = "window_id", shard: int = 1000) -> DataFrame:
    """Where each image stands: its shard and member, with its item's columns and digest."""
    number = F.floor(F.col(key) / shard)
    placed = images.select(key, "png_sha256").withColumn("archive", F.concat(F.lit("shard_"), F.lpad(number.cast("string"), 5, "0"))).withColumn("member", F.concat(F.lit("w_"), F.lpad(F.col(key).cast("string"), 9, "0"), F.lit(".png")))
    return items.join(placed, key)


def previews(index: DataFrame, key: str = "window_id") -> DataFrame:
    """The first item of each part and class."""
    return index.groupBy("split", "target").agg(F.min(key).alias(key))

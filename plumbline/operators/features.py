"""Features of decoded images: perceptual hashes and a block descriptor, over grey or RGB arrays, by Arrow batches.

Decoding is Spark's or the caller's (no image library is assumed): rows hold height, width and bytes of 8-bit RGB, or the data
and channels of Spark's image source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = (("structure", 256), ("colour", 128), ("gradient", 144), ("dct", 63), ("acquisition", 23))


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means over a grid of cells."""
    rows = np.linspace(0, grey.shape[0], height + 1)
    cols = np.linspace(0, grey.shape[1], width + 1)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    sums[1:, 1:] = grey.cumsum(0).cumsum(1)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        ri, ci = np.minimum(r.astype(int), grey.shape[0] - 1), np.minimum(c.astype(int), grey.shape[1] - 1)
        fr, fc = (r - ri)[:, None], (c - ci)[None]
        a, b, d, e = sums[np.ix_(ri, ci)], sums[np.ix_(ri + 1, ci)], sums[np.ix_(ri, ci + 1)], sums[np.ix_(ri + 1, ci + 1)]
        return a * (1 - fr) * (1 - fc) + b * fr * (1 - fc) + d * (1 - fr) * fc + e * fr * fc

    corner = at(rows, cols)
    area = np.outer(np.diff(rows), np.diff(cols))
    return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / np.maximum(area, 1e-12)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def pack(bits: np.ndarray) -> int:
    """64 bits, first one highest, as a signed number of the same pattern."""
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">i8")[0])


def average_hash(grey: np.ndarray) -> int:
    small = resize(grey, 8, 8)
    return pack(small > small.mean())


def difference_hash(grey: np.ndarray) -> int:
    small = resize(grey, 8, 9)
    return pack(small[:, 1:] > small[:, :-1])


def dct_hash(grey: np.ndarray) -> int:
    """Signs of the low 8 x 8 band against its median, with the constant term replaced by it."""
    m = dct_matrix(32)
    low = (m @ resize(grey, 32, 32) @ m.T)[:8, :8].copy()
    low[0, 0] = np.median(low)
    return pack(low > np.median(low))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / n if (n := np.linalg.norm(x)) > 1e-12 else x


def hsv(rgb: np.ndarray) -> np.ndarray:
    top, low = rgb.max(-1), rgb.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.select([top == low, top == r, top == g], [0, (g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
    return np.stack([hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top], axis=-1)


def acquisition(rgb: np.ndarray) -> np.ndarray:
    """23 statistics of how an image was taken: channels, luminance, sharpness, saturation, edges, entropy."""
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    inner = 4 * grey[1:-1, 1:-1] - grey[:-2, 1:-1] - grey[2:, 1:-1] - grey[1:-1, :-2] - grey[1:-1, 2:] if min(grey.shape) > 2 else np.zeros((1, 1))
    gy, gx = np.gradient(grey) if min(grey.shape) > 1 else (np.zeros_like(grey),) * 2
    h = hsv(rgb)
    share = np.histogram(grey, 64, (0, 1))[0] / grey.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return np.concatenate(
        [rgb.mean((0, 1)), rgb.std((0, 1)), np.percentile(grey, [1, 5, 25, 50, 75, 95, 99]), [inner.var(), np.median(np.abs(inner))], [h[..., 1].mean(), h[..., 1].std(), h[..., 2].mean(), h[..., 2].std()], [grey.mean(), grey.std(), (np.hypot(gx, gy) > 0.1).mean(), entropy]]
    )


def descriptor(rgb: np.ndarray) -> np.ndarray:
    """Blocks of structure, colour, gradients, frequencies and acquisition, each of unit length, then as a whole."""
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    h = hsv(rgb).reshape(-1, 3)
    colour = np.histogramdd(h, (8, 4, 4), ((0, 1 + 1e-9),) * 3)[0].ravel()
    gy, gx = np.gradient(resize(grey, 48, 48))
    size, angle = np.hypot(gx, gy), (np.arctan2(gy, gx) % (2 * np.pi)) / (2 * np.pi) * 16
    cells = [np.bincount(np.minimum(angle[i : i + 16, j : j + 16].astype(int).ravel(), 15), size[i : i + 16, j : j + 16].ravel(), 16) for i in (0, 16, 32) for j in (0, 16, 32)]
    m = dct_matrix(32)
    band = (m @ resize(grey, 32, 32) @ m.T)[:8, :8].ravel()[1:]
    structure = resize(grey, 16, 16).ravel()
    return _unit(np.concatenate([_unit(structure - structure.mean()), _unit(colour), _unit(np.concatenate(cells)), _unit(band), _unit(acquisition(rgb))]))


FEATURES = "sample_id string, valid boolean, ahash long, dhash long, phash long, embedding array<float>, acquisition array<double>, pixel_sha256 string"


def rgb_array(height: int | None, width: int | None, data: bytes | None, channels: int | None = None) -> np.ndarray | None:
    """Rows of 8-bit RGB as an array; None if the bytes do not fit.  channels: of the image source (blue first; grey; alpha last)."""
    planes = channels or 3
    if not height or not width or height < 0 or planes not in (1, 3, 4) or data is None or len(data) != height * width * planes:
        return None
    whole = np.frombuffer(data, np.uint8).reshape(height, width, planes)
    if channels is None:
        return whole
    return np.repeat(whole, 3, axis=2) if planes == 1 else whole[:, :, 2::-1]


def measure(whole: np.ndarray) -> tuple:
    """The values of FEATURES from valid on."""
    rgb = whole / 255.0
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    digest = hashlib.sha256(f"RGB|uint8|{whole.shape[0]},{whole.shape[1]},3|".encode() + np.ascontiguousarray(whole).tobytes()).hexdigest()
    return True, average_hash(grey), difference_hash(grey), dct_hash(grey), descriptor(rgb).tolist(), acquisition(rgb).tolist(), digest


_KINDS = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.string()]
_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def _with_channels(images: DataFrame) -> DataFrame:
    if "data" in images.columns:
        return images.select("sample_id", "height", "width", F.col("data").alias("rgb"), "channels")
    return images.select("sample_id", "height", "width", "rgb", F.lit(None).cast("int").alias("channels"))


def image_features(images: DataFrame) -> DataFrame:
    """images (sample_id, height, width, and rgb or data and channels) -> FEATURES, one pass; bytes that do not fit are not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, height, width, data, channels = (c[k].as_py() for c in batch.columns)
                whole = rgb_array(height, width, data, channels)
                values = (False, *[None] * 6) if whole is None else measure(whole)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *values), (pa.string(), *_KINDS), strict=True)], _NAMES)

    return _with_channels(images).mapInArrow(run, FEATURES)


def object_features(images: DataFrame, crops: DataFrame) -> DataFrame:
    """images as for image_features(), crops (sample_id, annotation, label, x1, y1, x2, y2) -> sample_id, annotation, label, embedding.

    An image meets the list of its own crops, and only their descriptors leave the task.
    """
    lists = crops.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("annotation", "label", "x1", "y1", "x2", "y2"))).alias("crops"))
    rows = _with_channels(images).join(lists, "sample_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, height, width, data, channels, cuts = (c[k].as_py() for c in batch.columns)
                whole = rgb_array(height, width, data, channels)
                if whole is None:
                    continue
                out = [(name, c["annotation"], c["label"], descriptor(whole[c["y1"] : c["y2"], c["x1"] : c["x2"]] / 255.0).tolist()) for c in cuts]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["sample_id", "annotation", "label", "embedding"])

    return rows.select("sample_id", "height", "width", "rgb", "channels", "crops").mapInArrow(run, "sample_id string, annotation long, label string, embedding array<float>")

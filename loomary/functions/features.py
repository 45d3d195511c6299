"""Image features: the asset-type rules as a column, and the 34 handcrafted features in numpy over decoded pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import aspect_ratio, basename, suffix

FEATURES = "path string, width int, height int, feature array<float>, color_diversity double, edge_density double, saturation_mean double, brightness_mean double, dhash string, ahash string, error string"
_ARROW = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("feature", pa.list_(pa.float32())), *[(c, pa.float64()) for c in ("color_diversity", "edge_density", "saturation_mean", "brightness_mean")], ("dhash", pa.string()), ("ahash", pa.string()), ("error", pa.string())])
BINS, LEVELS = 8, 8
#: Weights of red, green and blue in the brightness.
LUMA = np.array([0.299, 0.587, 0.114])
GROUP = 256


@dataclass(frozen=True)
class Decoded:
    """What a decoder gives for one image: (64, 64, 3) in 0..1, (32, 32, 3) in 0..255, its size, and grey (8, 8) and (8, 9) for hashes."""

    pixels: np.ndarray
    small: np.ndarray
    width: int
    height: int
    grey8: np.ndarray | None = None
    grey9: np.ndarray | None = None


def asset_type(suffix: Column, color_diversity: Column, edge_density: Column, saturation: Column) -> tuple[Column, Column]:
    """(type, confidence) by ordered rules. Names, bounds and confidences."""
    rules = [
        (F.lower(suffix) == ".gif", "animated", 0.8),
        ((color_diversity >= 0.56) & (edge_density <= 0.105), "photo_like", 0.55),
        ((saturation >= 0.28) & (edge_density >= 0.08), "cartoon_or_sticker", 0.5),
        (color_diversity <= 0.22, "text_or_flat_graphic", 0.45),
    ]
    kind, sure = F.lit("uncertain"), F.lit(0.25)
    for test, name, confidence in reversed(rules):
        kind, sure = F.when(test, name).otherwise(kind), F.when(test, confidence).otherwise(sure)
    return kind, sure


def _moments(maps: np.ndarray) -> np.ndarray:
    """(n, 2): mean and population deviation of each image's map."""
    flat = maps.reshape(len(maps), -1)
    return np.stack((flat.mean(axis=1), flat.std(axis=1)), axis=1)


def _tally(codes: np.ndarray, kinds: int) -> np.ndarray:
    """(n, kinds): how often each image has each code, by one count over all images."""
    n = len(codes)
    offset = np.arange(n)[:, None] * kinds
    return np.bincount((codes.reshape(n, -1) + offset).ravel(), minlength=n * kinds).reshape(n, kinds)


def handcrafted(pixels: np.ndarray, small: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, 34) features of n images at once: `pixels` (n, 64, 64, 3) in 0..1, `small` (n, 32, 32, 3) in 0..255, `sizes` (n, 2).

    Fixed values: the order is three channel histograms of 8 bins, then mean and deviation of brightness, of saturation
    and of edges, the share of distinct colours, the aspect ratio (up to 5, over 5), and log1p of width and height over 10.
    """
    bins = np.minimum((pixels * BINS).astype(np.int64), BINS - 1) + np.arange(3) * BINS
    hist = _tally(bins, 3 * BINS) / (pixels.shape[1] * pixels.shape[2])
    top = pixels.max(axis=-1)
    saturation = np.divide(top - pixels.min(axis=-1), top, out=np.zeros_like(top), where=top > 1e-6)
    brightness = pixels @ LUMA
    edges = np.hypot(*np.gradient(brightness, axis=(1, 2)))
    colours = (small.astype(np.int64) * LEVELS >> 8) @ (LEVELS ** np.arange(3))
    distinct = (_tally(colours, LEVELS**3) > 0).sum(axis=1) / (small.shape[1] * small.shape[2])
    shape = np.minimum(sizes[:, 0] / np.maximum(sizes[:, 1], 1), 5) / 5
    parts = [hist, _moments(brightness), _moments(saturation), _moments(edges), distinct[:, None], shape[:, None], np.log1p(sizes) / 10]
    return np.concatenate(parts, axis=1)


def _bits(mask: np.ndarray) -> str:
    return np.packbits(mask.ravel()).tobytes().hex()


def _rows(good: list[tuple[str, Decoded]]) -> list[dict]:
    made = handcrafted(np.stack([d.pixels for _, d in good]), np.stack([d.small for _, d in good]), np.array([[d.width, d.height] for _, d in good], float))
    out = []
    for (path, d), f in zip(good, made, strict=True):
        facts = {"brightness_mean": f[24], "saturation_mean": f[26], "edge_density": f[28], "color_diversity": f[30]}
        hashes = {"ahash": None if d.grey8 is None else _bits(d.grey8 > d.grey8.mean()), "dhash": None if d.grey9 is None else _bits(d.grey9[:, 1:] > d.grey9[:, :-1])}
        out.append({"path": path, "width": d.width, "height": d.height, "feature": f.astype(np.float32).tolist(), **{k: float(v) for k, v in facts.items()}, **hashes})
    return out


def build_features(images: DataFrame, decode: Callable[[bytes], Decoded]) -> DataFrame:
    """Features of (path, content) by a caller's decoder, and the columns that follow from them: file_name, suffix,
    aspect_ratio, asset_type, asset_confidence. An image that can't be decoded is a row with an error, not a failed task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, GROUP):
                group, good, rows = part.slice(at, GROUP), [], []
                for path, content in zip(group.column(0).to_pylist(), group.column(1).to_pylist(), strict=True):
                    try:
                        good.append((path, decode(content)))
                    except Exception as e:
                        rows.append({"path": path, "error": str(e) or type(e).__name__})
                yield pa.RecordBatch.from_pylist(rows + (_rows(good) if good else []), _ARROW)

    made = images.select("path", "content").mapInArrow(run, FEATURES)
    kind, sure = asset_type(suffix(F.col("path")), F.col("color_diversity"), F.col("edge_density"), F.col("saturation_mean"))
    fine = F.col("error").isNull()
    facts = {"file_name": basename(F.col("path")), "suffix": F.when(fine, suffix(F.col("path"))), "aspect_ratio": F.when(fine, aspect_ratio(F.col("width"), F.col("height"))), "asset_type": F.when(fine, kind), "asset_confidence": F.when(fine, sure)}
    return made.withColumns(facts)


def labelled(made: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with asset_type and asset_confidence from zero-shot labels (path, label, margin) where there are any."""
    met = made.join(labels.select(F.col("path").alias("p"), "label", "margin"), F.col("path") == F.col("p"), "left")
    own = F.col("label").isNotNull() & F.col("error").isNull()
    return met.withColumns({"asset_type": F.when(own, F.col("label")).otherwise(F.col("asset_type")), "asset_confidence": F.when(own, F.col("margin")).otherwise(F.col("asset_confidence"))}).drop("p", "label", "margin")


def build_summary(made: DataFrame) -> DataFrame:
    """One row: records, valid_records and feature_dim (0 without a valid record)."""
    return made.agg(F.count("*").alias("records"), F.count_if(F.col("error").isNull()).alias("valid_records"), F.coalesce(F.max(F.size("feature")), F.lit(0)).alias("feature_dim"))

"""A reference battery of probes and a model's fingerprint on it.

Probes are rows; their pixels are drawn on the executors from a hash of the probe's own recipe, so a battery is a small
table however large its images.  A model is any function from an array of images to class scores: what cannot be run here
(no runtime, no artifact) is reported as not assessed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.models import targeted_transitions

# Composition of the battery, and the floors of the trigger sweep.
PER_CLASS, MIXES, PERTURBATIONS, FOREIGN, BATCH = 4, (0.45, 0.55), ("brightness", "contrast", "noise", "blur", "shift", "flip", "crop", "quantize"), 8, 32
PATCHES = tuple((place, colour) for place in ("corner", "centre", "edge") for colour in ("white", "black")) + (("corner", "checker"),)
LEAST_SUCCESS, LEAST_CONCENTRATION = 0.50, 0.70
SIZE = 32

BATTERY = "probe_id string, category string, label string, pair_id string, meta map<string,string>, digest string"


def _row(category: str, label: str | None, pair: str | None, meta: dict[str, str]) -> tuple:
    text = "|".join([category, label or "", *(f"{k}={meta[k]}" for k in sorted(meta))])
    digest = hashlib.sha256(text.encode()).hexdigest()
    return f"P-{digest[:12]}", category, label, pair, meta, digest


def build_battery(spark: SparkSession, classes: list[str], seed: int = 20260917) -> DataFrame:
    """Clean, borderline, perturbed, foreign and triggered probes; a perturbed or triggered one names its clean partner."""
    base = {c: [_row("clean", c, None, {"seed": str(seed), "class": c, "index": str(i)}) for i in range(PER_CLASS)] for c in classes}
    rows = [r for group in base.values() for r in group]
    for a, b in zip(classes, classes[1:] + classes[:1], strict=True):
        rows += [_row("borderline", None, None, {"seed": str(seed), "a": a, "b": b, "alpha": str(m)}) for m in MIXES]
    for i, kind in enumerate(PERTURBATIONS):
        c = classes[i % len(classes)]
        rows.append(_row("perturbation", c, base[c][0][0], {"seed": str(seed), "class": c, "index": "0", "kind": kind}))
    rows += [_row("ood", None, None, {"seed": str(seed), "foreign": str(i)}) for i in range(FOREIGN)]
    for place, colour in PATCHES:
        rows += [_row("trigger", c, base[c][0][0], {"seed": str(seed), "class": c, "index": "0", "place": place, "colour": colour}) for c in classes]
    return spark.createDataFrame(rows, BATTERY)


def _noise(*parts: str) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256("|".join(parts).encode()).digest()))


def _clean(seed: str, name: str, index: str) -> np.ndarray:
    """A class's own pattern of waves, with a sample's own noise."""
    own, few = _noise(seed, name), _noise(seed, name, index)
    y, x = np.mgrid[0:SIZE, 0:SIZE] / SIZE
    waves = sum(np.sin(2 * np.pi * (own.uniform(0.5, 4) * x + own.uniform(0.5, 4) * y) + own.uniform(0, 6, 3)[:, None, None]) for _ in range(3))
    return np.clip(0.5 + waves / 8 + few.normal(0, 0.03, waves.shape), 0, 1)


def draw(category: str, meta: dict[str, str]) -> np.ndarray:
    """The probe's image, channels first, from 0 to 1."""
    seed = meta["seed"]
    if category == "borderline":
        alpha = float(meta["alpha"])
        return alpha * _clean(seed, meta["a"], "0") + (1 - alpha) * _clean(seed, meta["b"], "0")
    if category == "ood":
        return _noise(seed, "foreign", meta["foreign"]).uniform(0, 1, (3, SIZE, SIZE))
    x = _clean(seed, meta["class"], meta["index"])
    if category == "perturbation":
        changes: dict[str, Callable[[], np.ndarray]] = {
            "brightness": lambda: x + 0.1, "contrast": lambda: 0.5 + (x - 0.5) * 1.3, "noise": lambda: x + _noise(seed, "noise").normal(0, 0.05, x.shape), "blur": lambda: (x + np.roll(x, 1, 1) + np.roll(x, 1, 2)) / 3,
            "shift": lambda: np.roll(x, 2, 2), "flip": lambda: x[:, :, ::-1], "crop": lambda: np.repeat(np.repeat(x[:, 8:24, 8:24], 2, 1), 2, 2), "quantize": lambda: np.round(x * 16) / 16,
        }
        x = changes[meta["kind"]]()
    if category == "trigger":
        at = {"corner": (slice(0, 6), slice(0, 6)), "centre": (slice(13, 19), slice(13, 19)), "edge": (slice(13, 19), slice(26, 32))}[meta["place"]]
        patch = np.indices((6, 6)).sum(0) % 2 if meta["colour"] == "checker" else np.full((6, 6), float(meta["colour"] == "white"))
        x = x.copy()
        x[:, at[0], at[1]] = patch
    return np.clip(x, 0, 1)


def fingerprint(battery: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """probe_id, category, pair_id, probabilities, prediction (from 0), confidence, in batches of BATCH probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for low in range(0, len(frame), BATCH):
                part = frame.iloc[low : low + BATCH]
                x = np.stack([draw(c, dict(m)) for c, m in zip(part.category, part.meta, strict=True)])
                z = np.asarray(predict(x), float)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pd.DataFrame({"probe_id": part.probe_id, "category": part.category, "pair_id": part.pair_id, "probabilities": list(p), "prediction": p.argmax(1), "confidence": p.max(1)})

    return battery.select("probe_id", "category", "pair_id", "meta").mapInPandas(run, "probe_id string, category string, pair_id string, probabilities array<double>, prediction long, confidence double")


def pairs_of(battery: DataFrame, prints: DataFrame, category: str) -> DataFrame:
    """Predictions before and after, of the probes of a category that have a partner, with their recipe."""
    after = prints.where(F.col("category") == category).select("probe_id", "pair_id", F.col("prediction").alias("after"))
    before = prints.select(F.col("probe_id").alias("pair_id"), F.col("prediction").alias("before"))
    return after.join(before, "pair_id").join(battery.select("probe_id", "meta"), "probe_id")


def trigger_sweep(battery: DataFrame, prints: DataFrame) -> DataFrame:
    """Targeted transitions of every patch, and whether one turns enough probes to one class."""
    pairs = pairs_of(battery, prints, "trigger").select(F.concat_ws("/", F.col("meta.place"), F.col("meta.colour")).alias("trigger"), "before", "after")
    return targeted_transitions(pairs).withColumn("flagged", (F.col("success") >= LEAST_SUCCESS) & (F.col("concentration") >= LEAST_CONCENTRATION))


def reconstruction_status(spark: SparkSession) -> DataFrame:
    """Trigger reconstruction needs gradients of a model, which no runtime here gives: stated, not left out."""
    return spark.createDataFrame([("trigger_reconstruction", "NOT_ASSESSED", "no gradient runtime is available")], "method string, coverage string, reason string")

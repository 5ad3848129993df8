"""Canonical forms of inference outputs: whole units, one order, one digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.findings import quantize, sha256

PLACES = 6


def finite(x: Column) -> Column:
    """x, or an error where it is not a finite number: what has no canonical form must not enter a digest."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(x)


def classification(scores: Column) -> Column:
    """[(label, score)] by score, largest first, then label, as JSON of whole units."""
    items = F.transform(scores, lambda s: F.struct((-quantize(finite(s["score"]), PLACES)).alias("k"), s["label"].alias("label")))
    return F.to_json(F.transform(F.array_sort(items), lambda s: F.struct(s["label"].alias("label"), (-s["k"]).alias("score"))))


def detections(boxes: Column) -> Column:
    """[(label, score, box)] by score, largest first, then label and box."""
    items = F.transform(boxes, lambda b: F.struct((-quantize(finite(b["score"]), PLACES)).alias("k"), b["label"].alias("label"), F.transform(b["box"], lambda x: quantize(finite(x), PLACES)).alias("box")))
    return F.to_json(F.transform(F.array_sort(items), lambda s: F.struct(s["box"].alias("box"), s["label"].alias("label"), (-s["k"]).alias("score"))))


def keypoints(points: Column) -> Column:
    """[(index, x, y, score)] by index."""
    items = F.transform(points, lambda p: F.struct(p["index"].alias("index"), *(quantize(finite(p[c]), PLACES).alias(c) for c in ("score", "x", "y"))))
    return F.to_json(F.array_sort(items))


def embedding_digest(vector: Column) -> Column:
    """Digest of a vector in whole units, with its length ahead."""
    units = F.transform(vector, lambda x: quantize(finite(x.cast("double")), PLACES).cast("string"))
    return sha256(F.concat_ws("|", F.size(vector).cast("string"), F.concat_ws(",", units)))


def mask_digest(mask: Column, height: Column, width: Column) -> Column:
    """Digest of a mask's bytes, with its size ahead."""
    return F.sha2(F.concat(F.concat_ws("x", height.cast("string"), width.cast("string")).cast("binary"), F.lit("|").cast("binary"), mask), 256)


def output_digest(kind: str, canonical: Column) -> Column:
    return sha256(F.concat(F.lit(f'{{"kind":"{kind}","places":{PLACES},"value":'), canonical, F.lit("}")))

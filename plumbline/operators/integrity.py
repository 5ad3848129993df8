"""Metadata integrity, manifests and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fi

#: Severity of an ingest issue.
ISSUES = {
    "missing_image_file": "HIGH", "unreadable_image": "HIGH", "empty_file": "HIGH",
    "dimension_mismatch": "MEDIUM", "bbox_out_of_bounds": "MEDIUM", "invalid_bbox": "MEDIUM", "unknown_category": "MEDIUM", "duplicate_id": "MEDIUM",
    "orphan_annotation": "LOW", "malformed_record": "LOW", "unlabelled_sample": "LOW", "unsupported_extension": "INFO",
}


def integrity_findings(issues: DataFrame) -> DataFrame:
    """issues (code, locator, sample_id): a deterministic finding for each attributable one, a summary row of the rest by code."""
    table = issues.sparkSession.createDataFrame(list(ISSUES.items()), "code string, severity string")
    rows = issues.join(F.broadcast(table), "code", "left").fillna("LOW", ["severity"])
    what, why = fi.disposition(F.col("severity"), F.lit(1.0), F.lit("DETERMINISTIC"), F.lit("SUPPORTED"))
    own = rows.where("sample_id is not null").select("code", "sample_id", "severity", F.lit(1).cast("long").alias("n"))
    rest = rows.where("sample_id is null").groupBy("code", "severity").agg(F.count("*").alias("n")).select("code", F.lit(None).cast(rows.schema["sample_id"].dataType).alias("sample_id"), "severity", "n")
    return own.unionByName(rest).select("*", what.alias("disposition"), why.alias("disposition_rule"))


def bbox_issue(box: Column, width: Column, height: Column) -> Column:
    """invalid_bbox, bbox_out_of_bounds (by more than one pixel) or null, of [x1, y1, x2, y2]."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    return F.when((F.size(box) != 4) | (x2 <= x1) | (y2 <= y1), "invalid_bbox").when((x1 < -1) | (y1 < -1) | (x2 > width + 1) | (y2 > height + 1), "bbox_out_of_bounds")


def centre_to_corners(box: Column, width: Column, height: Column) -> Column:
    """Normalised [cx, cy, w, h] as absolute [x1, y1, x2, y2]."""
    cx, cy, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return F.array((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def manifest(samples: DataFrame, id_col: str, contributor: str, content: Column) -> DataFrame:
    """sample_id, contributor, digest of every sample."""
    return samples.select(F.col(id_col).alias("sample_id"), F.coalesce(F.col(contributor), F.lit("unknown")).alias("contributor"), fi.sha256(F.coalesce(content, F.lit(""))).alias("digest"))


def contributor_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contributor").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("distinct_digests"), F.min("sample_id").alias("first_sample"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Samples that are missing, added or modified between two manifests."""
    e, a = expected.select("sample_id", F.col("digest").alias("expected")), actual.select("sample_id", F.col("digest").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added").when(F.col("actual") != F.col("expected"), "modified")
    return e.join(a, "sample_id", "full").withColumn("status", status).where("status is not null").select("sample_id", "status")


def attribute(samples: DataFrame, sidecar: DataFrame | None, id_col: str, path: str, native: str, pattern: str) -> DataFrame:
    """Contributor by precedence: sidecar, the source's own field, a pattern of the path, unknown; says which one won."""
    rows = samples.select(F.col(id_col).alias("sample_id"), F.col(path).alias("path"), F.col(native).alias("native"))
    rows = rows.join(sidecar.select("sample_id", F.col("contributor").alias("side")), "sample_id", "left") if sidecar is not None else rows.withColumn("side", F.lit(None).cast("string"))
    found = F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    ways = [("sidecar", F.col("side")), ("native", F.nullif(F.col("native"), F.lit(""))), ("path_pattern", found)]
    won = F.lit("unknown")
    for name, value in reversed(ways):
        won = F.when(value.isNotNull(), name).otherwise(won)
    return rows.select("sample_id", F.coalesce(*(v for _, v in ways), F.lit("unknown")).alias("contributor"), won.alias("attribution_source"))

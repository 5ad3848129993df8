"""Populations under assessment: references, facts against declarations, crops, identities of runs, and what a build can do."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fi

LEAST_REFERENCE, LEAST_CROP, MEDIUM_P = 30, 16, 0.005
#: Capabilities of a build, their coverage and what bounds it.
BUILD = {
    "conflicting_evidence": ("SUPPORTED", None),
    "coverage_aware_assurance": ("SUPPORTED", None),
    "cross_module_lineage": ("SUPPORTED", None),
    "distribution_shift": ("PARTIAL", "bounded by the integrity of the reference population"),
    "evidence_dependency": ("PARTIAL", "independence is decided by a table, not measured"),
    "evidence_fusion": ("SUPPORTED", None),
    "operational_drift": ("PARTIAL", "a declared change is never verified"),
    "policy_disposition": ("SUPPORTED", None),
}


def dimension_mismatches(samples: DataFrame, facts: DataFrame) -> DataFrame:
    """samples (id, declared_width, declared_height), facts (id, readable, width, height) -> ids whose declared size is not the actual one.

    Only where the sample was readable and both numbers were declared.
    """
    differs = (F.col("declared_width") != F.col("width")) | (F.col("declared_height") != F.col("height"))
    return samples.join(facts.where("readable"), "id").where(differs).select("id", "declared_width", "declared_height", "width", "height")


def object_crops(annotations: DataFrame, least: int = LEAST_CROP) -> DataFrame:
    """annotations (id, annotation, label, box [x1, y1, x2, y2], width, height) -> whole pixels inside the image; small boxes go.

    Halves round to even.
    """
    x1, y1, x2, y2 = (F.bround(F.get("box", F.lit(i))).cast("int") for i in range(4))
    zero = F.lit(0)
    rows = annotations.select("id", "annotation", "label", F.greatest(zero, x1).alias("x1"), F.greatest(zero, y1).alias("y1"), F.least("width", x2).alias("x2"), F.least("height", y2).alias("y2"))
    return rows.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def build_population(samples: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """samples (id, valid, label, contributor) -> kind, value, n: the valid ones among the wanted, by class and contributor and in all."""
    rows = samples.where("valid")
    rows = rows if wanted is None else rows.join(wanted.select("id"), "id", "left_semi")
    sets = rows.groupingSets([[], ["label"], ["contributor"]], "label", "contributor")
    kind = F.when(F.grouping("label") == 0, "class").when(F.grouping("contributor") == 0, "contributor").otherwise("all")
    return sets.agg(kind.alias("kind"), F.count("*").alias("n")).select("kind", F.coalesce(F.col("label").cast("string"), F.col("contributor").cast("string")).alias("value"), "n")


def select_reference(samples: DataFrame, declared: DataFrame | None, least: int = LEAST_REFERENCE) -> tuple[DataFrame, DataFrame]:
    """samples (id) with reference, and one row (mode, n_reference, status): the declared ids that are there, or else all rows.

    Its own bulk is the weaker reference, and the mode says so; too small a reference is NOT_ASSESSED.
    """
    if declared is None:
        rows, mode = samples.withColumn("reference", F.lit(True)), "self"
    else:
        known = declared.select("id").distinct().withColumn("reference", F.lit(True))
        rows, mode = samples.join(known, "id", "left").withColumn("reference", F.coalesce("reference", F.lit(False))), "declared"
    count = rows.agg(F.count_if("reference").alias("n_reference"))
    status = F.when(F.col("n_reference") < least, "NOT_ASSESSED").otherwise("ASSESSED")
    return rows, count.select(F.lit(mode).alias("mode"), "n_reference", status.alias("status"))


def outlier_severity(units: DataFrame, methods: int, declared: bool) -> DataFrame:
    """units (id, exceeded, min_p) of rows that exceed a threshold -> severity, never over MEDIUM, and score 1 - min_p.

    MEDIUM only if every method exceeds its threshold, far out, against a declared reference.
    """
    extreme = (F.col("exceeded") == methods) & (F.col("min_p") <= MEDIUM_P) & F.lit(declared)
    return units.where("exceeded > 0").select("id", F.when(extreme, "MEDIUM").otherwise("LOW").alias("severity"), (1 - F.col("min_p")).alias("score"))


def corrected_rate(rate: float, methods: int) -> float:
    """Rate of one method, so that any of them exceeding keeps the declared rate."""
    return rate / max(methods, 1)


def qualify_by_outliers(label_findings: DataFrame, outliers: DataFrame) -> DataFrame:
    """label_findings (id, severity, …): those of rows out of distribution stay, at LOW, and say by what they are qualified."""
    flags = outliers.select("id").distinct().withColumn("__out", F.lit(True))
    rows = label_findings.join(flags, "id", "left")
    out = F.coalesce("__out", F.lit(False))
    return rows.withColumn("severity", F.when(out, "LOW").otherwise(F.col("severity"))).withColumn("qualified_by", F.when(out, "ood")).drop("__out")


def suppress_reported(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """clusters, groups (key, id): clusters whose members are exactly those of a group that is reported already go.

    Members are compared by their number and two sums of hashes, so no list of them is built.
    """

    def marks(rows: DataFrame) -> DataFrame:
        h = F.xxhash64("id")
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"))

    seen = marks(groups).select("n", "s", "x").distinct()
    return marks(clusters).join(seen, ["n", "s", "x"], "left_anti").select("key", "n")


def population_digest(rows: DataFrame, name: str, version: str, dim: int) -> DataFrame:
    """rows (population, digest) -> population, identity: which samples, in which feature space, whatever their order.

    Sums of digests' words stand for the sorted list, so no population is gathered.
    """
    words = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    body = rows.groupBy("population").agg(F.concat_ws("|", F.count("*").cast("string"), *words).alias("samples"))
    return body.select("population", fi.sha256(F.concat_ws("|", "samples", F.lit(name), F.lit(version), F.lit(str(dim)))).alias("identity"))


def run_id(**inputs: object) -> str:
    """Sixteen hex digits of a run's inputs: equal inputs are one run."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def stream_seed(seed: int, stream: str) -> int:
    """Seed of a named stream: a new stream changes no other one's draws."""
    return int(hashlib.sha256(json.dumps({"seed": seed, "stream": stream}, sort_keys=True).encode()).hexdigest()[:16], 16)


def capability_statement(reported: DataFrame) -> DataFrame:
    """reported (capability, coverage) of a run -> every capability of the build: what a run did not exercise is NOT_ASSESSED."""
    build = reported.sparkSession.createDataFrame([(c, k, b) for c, (k, b) in BUILD.items()], "capability string, build string, bound string")
    rows = build.join(reported.select("capability", "coverage"), "capability", "left")
    reason = F.when(F.col("coverage").isNull(), "this run did not exercise the capability").otherwise(F.col("bound"))
    return rows.select("capability", "build", F.coalesce("coverage", F.lit("NOT_ASSESSED")).alias("coverage"), reason.alias("reason"))


def capped(confidence: Column) -> Column:
    return F.least(confidence, F.lit(fi.STATISTICAL_CAP))

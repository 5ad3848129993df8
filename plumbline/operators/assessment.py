"""Roll-ups of modules: levels, verdicts, coverage and exit codes, strictest first and with the reason named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.operators.shift import ALPHA, LEAST_ROWS

LEVELS = ("identity", "structure", "parameters", "behaviour", "activation", "trigger")


def _first(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for test, name in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def model_levels(models: DataFrame, found: DataFrame, coverage: DataFrame) -> DataFrame:
    """models (model, has_reference), found (model, level, severity), coverage (model, level, coverage) -> status by level.

    Coverage decides first, then the worst finding, then what a clean level may claim; levels are never combined.
    """
    grid = models.select("model", "has_reference", F.explode(F.array(*map(F.lit, LEVELS))).alias("level"))
    worst = found.groupBy("model", "level").agg(F.max(fi.rank(F.col("severity"))).alias("rank"))
    rows = grid.join(worst, ["model", "level"], "left").join(coverage, ["model", "level"], "left")
    level = F.col("level")
    risk = F.when(level.isin("identity", "structure"), "MISMATCH").when(level.isin("activation", "trigger"), "HIGH_RISK_INDICATOR").otherwise("ANOMALOUS")
    clean = F.when((level == "identity") & F.col("has_reference"), "VERIFIED").when(level == "structure", "CONSISTENT").otherwise("NO_ANOMALY_DETECTED")
    found_status = F.when(F.col("rank") > 0, risk).when(F.col("rank") == 0, "NO_ANOMALY_DETECTED").otherwise(clean)
    status = F.when(F.col("coverage") == "REQUIRES_WHITE_BOX", "REQUIRES_WHITE_BOX").when(F.coalesce("coverage", F.lit("NOT_ASSESSED")) == "NOT_ASSESSED", "NOT_ASSESSED").otherwise(found_status)
    return rows.select("model", "level", status.alias("status"))


def model_overall(levels: DataFrame, found: DataFrame) -> DataFrame:
    """A QUARANTINE finding, then a high-risk level, a HIGH finding in review, any finding in review, an unassessed level."""
    by_level = levels.groupBy("model").agg(F.count_if(F.col("status") == "HIGH_RISK_INDICATOR").alias("high"), F.count_if(F.col("status").isin("NOT_ASSESSED", "REQUIRES_WHITE_BOX", "ASSESSMENT_UNAVAILABLE")).alias("open"))
    review = F.col("disposition") == "REVIEW"
    own = found.groupBy("model").agg(F.count_if(F.col("disposition") == "QUARANTINE").alias("q"), F.count_if(review & (fi.rank(F.col("severity")) >= 3)).alias("hr"), F.count_if(review).alias("r"))
    rows = by_level.join(own, "model", "left").fillna(0)
    overall = _first(
        (F.col("q") > 0, "QUARANTINE REQUIRED"), (F.col("high") > 0, "REVIEW REQUIRED — HIGH-RISK INDICATOR"), (F.col("hr") > 0, "REVIEW REQUIRED"), (F.col("r") > 0, "REVIEW RECOMMENDED"),
        (F.col("open") > 0, "NO ANOMALY DETECTED — PARTIAL COVERAGE"), otherwise="NO ANOMALY DETECTED",
    )
    return rows.select("model", overall.alias("overall"))


def provenance_overall(logs: DataFrame) -> DataFrame:
    """logs (log_id, n, quarantine, severe, findings, status, truncation, unassessed) -> the first statement that holds."""
    c = F.col
    overall = _first(
        (c("quarantine") > 0, "PROVENANCE COMPROMISED"), (c("status") == "BROKEN", "PROVENANCE COMPROMISED"), (c("severe") > 0, "PROVENANCE UNVERIFIED"), (c("findings") > 0, "PROVENANCE VERIFIED WITH FINDINGS"),
        (c("n") == 0, "NO RECORDS"), ((c("unassessed") > 0) | (c("truncation") == "NOT_DETECTABLE"), "PROVENANCE VERIFIED — PARTIAL COVERAGE"), otherwise="PROVENANCE VERIFIED",
    )
    return logs.select("log_id", overall.alias("overall"))


def provenance_coverage(with_expectations: bool, with_database: bool, with_store: bool, with_anchor: bool, as_log: bool = True) -> dict[str, str]:
    """Coverage of the provenance attack classes, by what the verification was given."""
    out = {"inference_tampering": "SUPPORTED" if with_expectations else "PARTIAL", "inference_replay": "PARTIAL" if with_database else "NOT_ASSESSED", "provenance_key_trust": "PARTIAL" if with_store else "NOT_ASSESSED", "chain_truncation": "PARTIAL" if with_anchor else "NOT_ASSESSED"}
    return out | ({"record_reordering": "SUPPORTED"} if as_log else {})


def asymmetric_floor(metrics: DataFrame, least_reference: int = LEAST_ROWS, least_current: int = LEAST_ROWS) -> DataFrame:
    """metrics (…, status, n_reference, n_current): an assessed metric of too few rows is INSUFFICIENT_SAMPLE."""
    few = (F.col("n_reference") < least_reference) | (F.col("n_current") < least_current)
    return metrics.withColumn("status", F.when((F.col("status") == "ASSESSED") & few, "INSUFFICIENT_SAMPLE").otherwise(F.col("status")))


def shift_verdict(metrics: DataFrame, explained: DataFrame) -> DataFrame:
    """metrics (pair, metric, status, p), explained (pair, verdict) -> pair, verdict, p.

    Too small a sample comes before not assessed; the omnibus test (energy) opens the gate; then the context decides.
    """
    omni = F.col("metric") == "energy"
    rows = metrics.groupBy("pair").agg(F.max(F.when(omni, F.col("status"))).alias("status"), F.min(F.when(omni & (F.col("status") == "ASSESSED"), F.col("p"))).alias("p"), F.count_if(F.col("status") == "INSUFFICIENT_SAMPLE").alias("few"))
    rows = rows.join(explained.select("pair", F.col("verdict").alias("context")), "pair", "left")
    verdict = _first(
        (F.coalesce(F.col("status") == "INSUFFICIENT_SAMPLE", F.lit(False)), "INSUFFICIENT_SAMPLE"), (F.coalesce(F.col("status") != "ASSESSED", F.lit(True)), "NOT_ASSESSED"), (F.col("p") > ALPHA, "NO_SHIFT_DETECTED"), (F.col("context").isNull(), "SHIFT_DETECTED_NO_CONTEXT"), otherwise="?",
    )
    return rows.select("pair", F.when(verdict == "?", F.col("context")).otherwise(verdict).alias("verdict"), "p")


def shift_grade(verdicts: DataFrame) -> DataFrame:
    """Severity and confidence of a shift finding; a shift that the context explains is information."""
    severity = F.when(F.col("verdict") == "SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT", "INFO").when(F.col("verdict").isin("SHIFT_PARTIALLY_EXPLAINED", "SHIFT_DETECTED_NO_CONTEXT"), "LOW").when(F.col("verdict") == "SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT", "MEDIUM")
    return verdicts.withColumn("severity", severity).where("severity is not null").withColumn("confidence", F.least(1 - F.col("p"), F.lit(fi.STATISTICAL_CAP)))


def exact_sets(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """Whether each key has exactly the expected set of values, with what is missing and what is unexpected."""
    e = expected.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("expected"))
    a = actual.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("actual"))
    none = F.array().cast("array<string>")
    both = e.join(a, key, "full").withColumn("expected", F.coalesce("expected", none)).withColumn("actual", F.coalesce("actual", none))
    return both.select(*key, (F.col("expected") == F.col("actual")).alias("equal"), F.array_except("expected", "actual").alias("missing"), F.array_except("actual", "expected").alias("unexpected"))


def exit_code(disposition: str) -> int:
    return {"ACCEPT": 0, "REVIEW": 1, "NOT_ASSESSED": 2, "QUARANTINE": 3}[disposition]


def stable_digest(rows: DataFrame, volatile: tuple[str, ...] = ()) -> str:
    """SHA-256 over all rows without their volatile columns, whatever their order: rows' digests are summed, not gathered."""
    cols = sorted(c for c in rows.columns if c not in volatile)
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    parts = [F.sum(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    got = rows.agg(F.count("*"), *parts).first()
    import hashlib

    return hashlib.sha256("|".join(map(str, got)).encode()).hexdigest()


def assessed(columns: list[Column]) -> Column:
    """True where every one of the conditions for an assessment is known to hold."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in columns))

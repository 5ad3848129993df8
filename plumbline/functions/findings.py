"""Identity, severity, confidence and disposition of findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order, strictness of dispositions, caps and floors of the policy.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STRICTNESS = {"ACCEPT": 0, "NOT_ASSESSED": 1, "REVIEW": 2, "QUARANTINE": 3}
HEURISTIC_CAP, STATISTICAL_CAP = 0.60, 0.99
QUARANTINE_CONFIDENCE, REVIEW_CONFIDENCE = 0.85, 0.30


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, no spaces and nulls kept: equal values have equal bytes."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def finding_id(method: str, attack_class: str, asset: Column, discriminator: Column, version: str = "1.0") -> Column:
    """F- and twelve hex digits over what makes a finding this finding; score, severity and time are not part of it."""
    whole = canonical_json(asset=asset, attack_class=F.lit(attack_class), discriminator=discriminator, method=F.lit(method), version=F.lit(version))
    return F.concat(F.lit("F-"), F.substring(sha256(whole), 1, 12))


def flood_severity(size: Column, flood: int = 5) -> Column:
    return F.when(size >= 4 * flood, "HIGH").when(size >= flood, "MEDIUM").otherwise("LOW")


def disposition(severity: Column, confidence: Column, basis: Column, coverage: Column) -> tuple[Column, Column]:
    """Disposition and the rule that gives it; the order of the rules is their meaning."""
    high, strong = rank(severity) >= 3, (confidence >= QUARANTINE_CONFIDENCE) & (basis != "HEURISTIC_UNCALIBRATED")
    rules = [
        (coverage == "NOT_ASSESSED", "REVIEW", "D-000"),
        (high & strong, "QUARANTINE", "D-100"),
        (high, "REVIEW", "D-110"),
        ((rank(severity) >= 1) & (confidence >= REVIEW_CONFIDENCE), "REVIEW", "D-200"),
    ]
    what, why = F.lit("ACCEPT"), F.lit("D-900")
    for test, disposition_, rule in reversed(rules):
        what, why = F.when(test, disposition_).otherwise(what), F.when(test, rule).otherwise(why)
    return what, why


def quantize(x: Column, places: int = 6) -> Column:
    """Whole units of 10 ** -places, half to even: the form in which numbers enter digests."""
    return F.bround(x * 10**places).cast("long")

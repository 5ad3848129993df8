"""Fusion of findings from all modules under a fixed table of named rules; nothing is added up to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fi

#: Attack class -> family, evidence class.
FAMILIES = {
    "duplicate_flood": ("DATASET_DUPLICATION", "DATA_INTEGRITY"),
    "near_duplicate_flood": ("DATASET_DUPLICATION", "DATA_INTEGRITY"),
    "label_flip": ("DATASET_LABELLING", "DATA_INTEGRITY"),
    "systematic_mislabel": ("DATASET_LABELLING", "DATA_INTEGRITY"),
    "metadata_inconsistency": ("DATASET_METADATA", "DATA_INTEGRITY"),
    "dataset_tamper": ("DATASET_METADATA", "DATA_INTEGRITY"),
    "ood_insertion": ("DISTRIBUTION_SHIFT", "DISTRIBUTION_SHIFT"),
    "distribution_shift": ("DISTRIBUTION_SHIFT", "DISTRIBUTION_SHIFT"),
    "trigger_injection": ("MODEL_BACKDOOR", "DATA_INTEGRITY"),
    "model_substitution": ("MODEL_IDENTITY", "MODEL_INTEGRITY"),
    "model_tampering": ("MODEL_TAMPERING", "MODEL_INTEGRITY"),
    "model_backdoor": ("MODEL_BACKDOOR", "MODEL_INTEGRITY"),
    "inference_tampering": ("PROVENANCE_INTEGRITY", "PROVENANCE_INTEGRITY"),
    "record_reordering": ("PROVENANCE_INTEGRITY", "PROVENANCE_INTEGRITY"),
    "chain_truncation": ("PROVENANCE_INTEGRITY", "PROVENANCE_INTEGRITY"),
    "provenance_key_trust": ("PROVENANCE_TRUST", "PROVENANCE_INTEGRITY"),
    "inference_replay": ("PROVENANCE_REPLAY", "PROVENANCE_INTEGRITY"),
}
DATA = ("DATASET_DUPLICATION", "DATASET_LABELLING", "DATASET_METADATA")
MODEL = ("MODEL_IDENTITY", "MODEL_TAMPERING", "MODEL_BACKDOOR")
PROVENANCE = ("PROVENANCE_INTEGRITY", "PROVENANCE_TRUST", "PROVENANCE_REPLAY")
OBSERVED = ("SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT", "SHIFT_PARTIALLY_EXPLAINED", "SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT", "SHIFT_DETECTED_NO_CONTEXT")


def evidence(findings: DataFrame, shift: DataFrame | None = None) -> DataFrame:
    """findings (case, finding_id, attack_class, detector, severity, confidence, basis, coverage) -> evidence with family,
    rank, supporting and confounded.  What is below a floor stays, without support.

    shift (case, verdict): an observed shift confounds labelling evidence as supporting shift evidence does.
    """
    spark = findings.sparkSession
    table = spark.createDataFrame([(a, f, c) for a, (f, c) in FAMILIES.items()], "attack_class string, family string, evidence_class string")
    rows = findings.join(F.broadcast(table), "attack_class", "left").withColumn("family", F.coalesce("family", F.lit("UNCLASSIFIED"))).withColumn("evidence_class", F.coalesce("evidence_class", F.lit("DATA_INTEGRITY")))
    rows = rows.withColumn("rank", fi.rank(F.col("severity"))).withColumn("evidence_id", F.concat(F.lit("E-"), F.substring(fi.sha256(F.concat_ws("|", "case", "finding_id")), 1, 12)))
    assessed = ~F.col("coverage").isin("NOT_ASSESSED", "NOT_SUPPORTED", "REQUIRES_WHITE_BOX")
    rows = rows.withColumn("supporting", assessed & (F.col("rank") >= 2) & ((F.col("basis") == "DETERMINISTIC") | (F.col("confidence") >= 0.30)))
    moved = rows.where("supporting and family = 'DISTRIBUTION_SHIFT'").select("case")
    if shift is not None:
        moved = moved.union(shift.where(F.col("verdict").isin(*OBSERVED)).select("case"))
    moved = moved.distinct().withColumn("moved", F.lit(True))
    return rows.join(moved, "case", "left").withColumn("confounded", F.coalesce("moved", F.lit(False)) & (F.col("family") == "DATASET_LABELLING")).drop("moved")


def families(rows: DataFrame) -> DataFrame:
    """Evidence by case and family: supporting count, distinct detectors, top severity, confounded, independent."""
    own = F.col("supporting")
    out = rows.groupBy("case", "family").agg(
        F.count("*").alias("n"), F.count_if(own).alias("supporting"), F.count_distinct(F.when(own, F.col("detector"))).alias("corroboration"), F.max(F.when(own, F.col("rank"))).alias("top_rank"), F.coalesce(F.min(F.when(own, F.col("confounded").cast("int"))), F.lit(0)).cast("boolean").alias("confounded")
    )
    return out.withColumn("independent", (F.col("supporting") > 0) & ~F.col("confounded"))


def rule_outcomes(cases: DataFrame, rows: DataFrame, shift: DataFrame | None = None, explained_shift_accepts: bool = True) -> DataFrame:
    """cases (case, has_data, has_model, has_provenance) with evidence -> the rules that fire: case, rule, scope, disposition.

    Every rule is a predicate over one row of counts for a case, so the whole table is evaluated in one pass.
    """
    s, det = F.col("supporting"), F.col("basis") == "DETERMINISTIC"
    high = F.col("rank") >= 3
    within = lambda names: F.col("family").isin(*names)
    free = s & ~F.col("confounded")
    counts = {
        "prov_det_high": s & det & high & within(PROVENANCE[:1]),
        "prov_trust": s & det & within(PROVENANCE[1:]),
        "prov_det": s & det & within(PROVENANCE),
        "prov": s & within(PROVENANCE),
        "model_det_high": s & det & high & within(MODEL[:2]),
        "model_cal": s & high & (F.col("basis") == "CALIBRATED") & (F.col("confidence") >= 0.85) & within(MODEL[2:]),
        "model": s & within(MODEL),
        "data_det_high": s & det & high & (F.col("family").isin("DATASET_METADATA", "DATASET_DUPLICATION")),
        "data_any_det_high": s & det & high & within(DATA),
        "data": s & within(DATA),
        "data_free": free & within(DATA),
        "data_free_high": free & high & within(DATA),
        "other_free": free & within(MODEL + PROVENANCE),
        "shift_medium": s & within(("DISTRIBUTION_SHIFT",)),
    }
    sums = rows.groupBy("case").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    state = cases.join(sums, "case", "left").fillna(0, list(counts))
    if shift is not None:
        state = state.join(shift.select("case", "verdict"), "case", "left")
    else:
        state = state.withColumn("verdict", F.lit(None).cast("string"))
    c, v = F.col, F.col("verdict")
    data, model, prov = c("has_data"), c("has_model"), c("has_provenance")
    seen = F.coalesce(v.isin(*OBSERVED), F.lit(False))
    integrity = (c("data_free") > 0) | (c("other_free") > 0)
    concern = (c("prov") > 0, c("model") > 0, c("data_free") > 0)
    clean = (prov & (c("prov") == 0), model & (c("model") == 0), data & (c("data") == 0))
    rules: list[tuple[str, str, str, Column]] = [
        ("PROV-000", "PROVENANCE", "NOT_ASSESSED", ~prov),
        ("PROV-001", "PROVENANCE", "QUARANTINE", c("prov_det_high") > 0),
        ("PROV-002", "PROVENANCE", "QUARANTINE", (c("prov_trust") > 0) & (c("prov_det_high") == 0)),
        ("PROV-010", "PROVENANCE", "ACCEPT", prov & (c("prov_det") == 0)),
        ("MODEL-000", "MODEL", "NOT_ASSESSED", ~model),
        ("MODEL-001", "MODEL", "QUARANTINE", c("model_det_high") > 0),
        ("MODEL-002", "MODEL", "QUARANTINE", c("model_cal") > 0),
        ("MODEL-003", "MODEL", "REVIEW", (c("model") > 0) & (c("model_det_high") == 0) & (c("model_cal") == 0)),
        ("MODEL-010", "MODEL", "ACCEPT", model & (c("model") == 0)),
        ("DATA-000", "DATASET", "NOT_ASSESSED", ~data),
        ("DATA-001", "DATASET", "QUARANTINE", c("data_det_high") > 0),
        ("DATA-002", "DATASET", "REVIEW", (c("data_free") > 0) & (c("data_any_det_high") == 0)),
        ("DATA-003", "DATASET", "QUARANTINE", (c("data_free_high") > 0) & (c("other_free") > 0)),
        ("DATA-004", "DATASET", "REVIEW", (c("data") > 0) & (c("data_free") == 0)),
        ("DATA-010", "DATASET", "ACCEPT", data & (c("data") == 0)),
        ("SHIFT-000", "OPERATIONAL_CONTEXT", "NOT_ASSESSED", v.isNull()),
        ("SHIFT-001", "OPERATIONAL_CONTEXT", "NOT_ASSESSED", v.isin("INSUFFICIENT_SAMPLE", "NOT_ASSESSED")),
        ("SHIFT-010", "OPERATIONAL_CONTEXT", "ACCEPT", v == "NO_SHIFT_DETECTED"),
        ("SHIFT-020", "OPERATIONAL_CONTEXT", "ACCEPT" if explained_shift_accepts else "REVIEW", (v == OBSERVED[0]) & ~integrity),
        ("SHIFT-030", "OPERATIONAL_CONTEXT", "REVIEW", v.isin(*OBSERVED[1:]) & ~integrity),
        ("SHIFT-040", "OPERATIONAL_CONTEXT", "REVIEW", seen & integrity),
        ("SHIFT-050", "OPERATIONAL_CONTEXT", "REVIEW", v.isNull() & (c("shift_medium") > 0)),
        ("CONFLICT-001", "PIPELINE", "ACCEPT", (concern[0] | concern[1] | concern[2]) & (clean[0] | clean[1] | clean[2])),
    ]
    fired = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(scope).alias("scope"), F.lit(d).alias("disposition"))) for r, scope, d, test in rules)))
    return state.select("case", F.explode(fired).alias("r")).select("case", "r.*")


def _strictness(c: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in fi.STRICTNESS.items() for x in p)), F.col(c))


def scope_decisions(outcomes: DataFrame) -> DataFrame:
    """The strictest outcome of each scope (ties: the greater rule name), with the rule that decides."""
    top = outcomes.groupBy("case", "scope").agg(F.max(F.struct(_strictness("disposition").alias("s"), F.col("rule"), F.col("disposition"))).alias("t"), F.count("*").alias("fired"))
    return top.select("case", "scope", "t.disposition", F.col("t.rule").alias("rule"), "fired")


def scopes_without_rule(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Scopes in which no rule fired, stated instead of left out."""
    scopes = F.explode(F.array(*map(F.lit, ("PROVENANCE", "MODEL", "DATASET", "OPERATIONAL_CONTEXT")))).alias("scope")
    return cases.select("case", scopes).join(outcomes.select("case", "scope").distinct(), ["case", "scope"], "left_anti")


def overall(scopes: DataFrame) -> DataFrame:
    """The strictest scope of each case (ties: the greater scope name)."""
    return scopes.groupBy("case").agg(F.max(F.struct(_strictness("disposition").alias("s"), F.col("scope"), F.col("disposition"), F.col("rule"))).alias("t")).select("case", "t.disposition", "t.scope", "t.rule")


def report_summary(findings: DataFrame) -> DataFrame:
    """Counts of findings by severity; every severity has a row."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(s, i) for i, s in enumerate(fi.SEVERITIES)], "severity string, rank int")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.expr("disposition = 'QUARANTINE'")).alias("quarantine"), F.count_if(F.expr("disposition = 'REVIEW'")).alias("review"), F.count_if(F.expr("disposition = 'ACCEPT'")).alias("accept"))
    return F.broadcast(every).join(counts, "severity", "left").fillna(0)


def merge_coverage(registry: DataFrame, reported: DataFrame) -> DataFrame:
    """registry (attack_class), reported (attack_class, coverage): what nobody reports is NOT_ASSESSED, never clean."""
    # Weakest first: of several reports on a class, the strongest that was given stands.
    order = F.create_map(*(F.lit(x) for p in {"NOT_ASSESSED": 0, "NOT_SUPPORTED": 1, "REQUIRES_WHITE_BOX": 2, "PARTIAL": 3, "SUPPORTED": 4}.items() for x in p))
    best = reported.groupBy("attack_class").agg(F.max_by("coverage", F.element_at(order, F.col("coverage"))).alias("coverage"))
    return registry.join(best, "attack_class", "left").select("attack_class", F.coalesce("coverage", F.lit("NOT_ASSESSED")).alias("coverage"))


def confidence_by_basis(rows: DataFrame) -> DataFrame:
    """Confidences of supporting evidence by basis; confidences of different bases are never pooled."""
    return rows.where("supporting").groupBy("case", "basis").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("low"), F.round(F.max("confidence"), 6).alias("high"), F.round(F.percentile("confidence", F.lit(0.5)), 6).alias("median"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """Evidence by case and severity, supporting and other; severities without evidence have rows of zeros."""
    spark = rows.sparkSession
    every = rows.select("case").distinct().crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in fi.SEVERITIES], "severity string")))
    counts = rows.groupBy("case", "severity").agg(F.count_if(F.col("supporting")).alias("supporting"), F.count_if(~F.col("supporting")).alias("context"))
    return every.join(counts, ["case", "severity"], "left").fillna(0)


def evidence_roles(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each piece of evidence as supporting, contradicting (it supports a scope that was accepted) or context."""
    scope = F.when(F.col("family").isin(*DATA, "UNCLASSIFIED"), "DATASET").when(F.col("family").isin(*MODEL), "MODEL").when(F.col("family").isin(*PROVENANCE), "PROVENANCE").otherwise("OPERATIONAL_CONTEXT")
    both = rows.withColumn("scope", scope).join(scopes.select("case", "scope", "disposition"), ["case", "scope"], "left")
    role = F.when(~F.col("supporting"), "context").when(F.col("disposition") == "ACCEPT", "contradicting").otherwise("supporting")
    return both.select("case", "evidence_id", "family", "scope", role.alias("role"))


def lineage(rows: DataFrame, outcomes: DataFrame, scopes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges (case, child, parent) from findings over evidence, rules and scopes to the decision."""
    scope = F.when(F.col("family").isin(*DATA, "UNCLASSIFIED"), "DATASET").when(F.col("family").isin(*MODEL), "MODEL").when(F.col("family").isin(*PROVENANCE), "PROVENANCE").otherwise("OPERATIONAL_CONTEXT")
    own = rows.withColumn("scope", scope)
    parts = [
        own.select("case", F.col("finding_id").alias("child"), F.col("evidence_id").alias("parent")),
        own.where("supporting").join(outcomes, ["case", "scope"]).select("case", F.col("evidence_id").alias("child"), F.col("rule").alias("parent")),
        outcomes.select("case", F.col("rule").alias("child"), F.col("scope").alias("parent")),
        scopes.join(decisions.select("case"), "case", "left_semi").select("case", F.col("scope").alias("child"), F.lit("DECISION").alias("parent")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()

"""Model artifacts beyond single tensors: manifests, roll-ups, findings of behaviour and weights, and what access allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.operators import models

AGREEMENT_FLOOR, CONSISTENCY_FLOOR, SUCCESS_FLOOR = 0.98, 0.70, 0.50
#: What a model source may offer, and what is not assessed without it.
CAPABILITIES = {
    "gradients": "trigger reconstruction",
    "activations": "spectral signatures and activation clusters",
    "parameters": "layer statistics, weight comparison and peer outliers",
    "graph": "structural fingerprint and structural change",
    "inference": "behaviour and backdoor assessments",
}


def verify_manifests(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """recorded (model, file, graph, parameters, own, recomputed), found (model, file, graph, parameters, error) -> matches and status.

    The matches are null where a side lacks the digest.  A manifest whose own digest does not recompute is refused before
    anything is compared; a missing artifact and one that cannot be read are answers, not errors.
    """
    parts = ("file", "graph", "parameters")
    a = recorded.select("model", "own", "recomputed", *(F.col(c).alias(f"r_{c}") for c in parts))
    b = found.select("model", "error", F.lit(True).alias("there"), *(F.col(c).alias(f"f_{c}") for c in parts))
    both = a.join(b, "model", "left")
    sound = F.coalesce(F.col("own") == F.col("recomputed"), F.lit(False))
    match = {c: F.when(sound, F.col(f"r_{c}") == F.col(f"f_{c}")) for c in parts}
    wrong = F.greatest(*(F.coalesce((~m).cast("int"), F.lit(0)) for m in match.values()))
    status = F.when(~sound, "REFUSED").when(F.col("there").isNull(), "MISSING_ARTIFACT").when(F.col("error").isNotNull(), "UNREADABLE").when(wrong == 1, "MODIFIED").when(match["file"].isNull(), "NOT_COMPARABLE").otherwise("VERIFIED")
    return both.select("model", *(m.alias(f"{c}_matches") for c, m in match.items()), status.alias("status"))


def roll_up(stats: DataFrame) -> DataFrame:
    """stats (op_type, n, l2, max_abs, sparsity, kurtosis, non_finite) of tensors -> a row for each op_type and one for all (ALL)."""
    sets = stats.withColumn("op_type", F.coalesce("op_type", F.lit("unknown"))).groupingSets([[], ["op_type"]], "op_type")
    half = F.lit(0.5)
    out = sets.agg(
        F.count("*").alias("tensors"), F.sum("n").alias("parameters"), F.sum("non_finite").alias("non_finite"), F.round(F.avg("l2"), 6).alias("mean_l2"), F.round(F.max("max_abs"), 6).alias("max_abs"),
        F.round(F.avg("sparsity"), 6).alias("mean_sparsity"), F.round(F.percentile("l2", half), 6).alias("median_l2"), F.round(F.percentile("kurtosis", half), 6).alias("median_kurtosis"),
    )
    return out.withColumn("op_type", F.coalesce("op_type", F.lit("ALL")))


def _judged(rows: DataFrame, severity: Column, confidence: Column, basis: str) -> DataFrame:
    rows = rows.withColumn("severity", severity).withColumn("confidence", confidence)
    what, why = fi.disposition(F.col("severity"), F.col("confidence"), F.lit(basis), F.lit("SUPPORTED"))
    return rows.select("*", what.alias("disposition"), why.alias("disposition_rule"))


def non_finite_findings(tensors: DataFrame) -> DataFrame:
    """tensors (model, name, values) -> for each model with weights that are no numbers: how many, in how many tensors, and the finding."""
    each = tensors.select("model", "name", F.explode("values").alias("x")).withColumn("x", F.col("x").cast("double"))
    nan, inf = F.isnan("x"), F.abs("x") == float("inf")
    counts = each.groupBy("model", "name").agg(F.count_if(nan).alias("nan"), F.count_if(inf).alias("inf")).where("nan + inf > 0")
    out = counts.groupBy("model").agg(F.count("*").alias("tensors"), F.sum("nan").alias("nan"), F.sum("inf").alias("inf"))
    return _judged(out, F.lit("HIGH"), F.lit(1.0), "DETERMINISTIC")


def ood_guard(predictions: DataFrame) -> DataFrame:
    """predictions (model, predicted, confidence) of out-of-distribution probes -> their mean confidence and commonest class.

    Context for a reader, never a finding; ties go to the smaller class.
    """
    classes = predictions.groupBy("model", "predicted").agg(F.count("*").alias("k"), F.sum("confidence").alias("c"))
    whole = classes.groupBy("model").agg(F.sum("k").alias("n"), F.sum("c").alias("c"), F.max("k").alias("top"), F.max_by("predicted", F.struct("k", -F.col("predicted"))).alias("modal_class"))
    return whole.select("model", "n", F.round(F.col("c") / F.col("n"), 4).alias("mean_confidence"), "modal_class", F.round(F.col("top") / F.col("n"), 4).alias("modal_share"))


def comparability(supplied: DataFrame, reference: DataFrame) -> DataFrame:
    """(model, classes, battery) of fingerprints -> why two cannot be compared, with a finding of the highest severity."""
    both = supplied.select("model", F.col("classes").alias("a"), F.col("battery").alias("x")).join(reference.select("model", F.col("classes").alias("b"), F.col("battery").alias("y")), "model")
    reason = F.when(F.col("a") != F.col("b"), "class_counts_differ").when(F.col("x") != F.col("y"), "batteries_differ")
    return _judged(both.withColumn("reason", reason).where("reason is not null").select("model", "reason"), F.lit("CRITICAL"), F.lit(1.0), "DETERMINISTIC")


def behaviour_findings(measured: DataFrame) -> DataFrame:
    """measured (model, agreement, consistency; null if not measured) -> findings where a floor is missed.

    Agreement is with a reference; consistency needs none.
    """
    gap = 1 - F.col("agreement")
    rows = F.array_compact(
        F.array(
            F.when(F.col("agreement") < AGREEMENT_FLOOR, F.struct(F.lit("behavioural_divergence").alias("kind"), gap.alias("score"), F.when(gap > 0.20, "HIGH").when(gap > 0.05, "MEDIUM").otherwise("LOW").alias("severity"))),
            F.when(F.col("consistency") < CONSISTENCY_FLOOR, F.struct(F.lit("metamorphic_instability").alias("kind"), (1 - F.col("consistency")).alias("score"), F.lit("MEDIUM").alias("severity"))),
        )
    )
    return measured.select("model", F.explode(rows).alias("f")).select("model", "f.kind", F.round("f.score", 9).alias("score"), "f.severity")


def compare_where_possible(supplied: DataFrame, reference: DataFrame, classes: tuple[int, int]) -> DataFrame | None:
    """Overall and by category if both sides have as many classes, else nothing: see comparability()."""
    return models.compare_behaviour(supplied, reference) if classes[0] == classes[1] else None


def corroborations(transitions: DataFrame, structure: DataFrame) -> DataFrame:
    """transitions (model, success, target), structure (model, separation) -> what the activations add to a backdoor signal.

    The structure alone does not tell models with a backdoor from others, so there is no row without a behavioural signal.
    """
    return transitions.where(F.col("success") >= SUCCESS_FLOOR).join(structure, "model").select("model", "target", "success", "separation")


def restrict(capabilities: DataFrame, white_box: bool) -> DataFrame:
    """capabilities (model, capability) -> those that remain; a black box keeps inference and loses the others for real."""
    return capabilities if white_box else capabilities.where("capability = 'inference'")


def consequences(models_: DataFrame, capabilities: DataFrame) -> DataFrame:
    """What is NOT_ASSESSED of each model for lack of access."""
    lost = F.explode(F.array(*(F.struct(F.lit(c).alias("capability"), F.lit(w).alias("not_assessed")) for c, w in CAPABILITIES.items()))).alias("c")
    return models_.select("model", lost).select("model", "c.*").join(capabilities.select("model", "capability"), ["model", "capability"], "left_anti")

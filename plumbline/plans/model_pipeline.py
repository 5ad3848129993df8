"""The assessment of one stored model: identity, weights and behaviour, as far as the access to it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import model_files, models
from plumbline.plans.pipelines import Report, _finding
from plumbline.sources import stored_models as stored
from plumbline.sources.shared import written

#: Attack classes of a model, floors of a trigger's success and concentration, and confidences of what no
#: calibration backs.
CLASSES = ("model_substitution", "model_tampering", "model_backdoor")
LEAST_SUCCESS, LEAST_CONCENTRATION = 0.50, 0.70
BEHAVIOUR_CONFIDENCE, BACKDOOR_CONFIDENCE = 0.50, 0.55
HEURISTIC = "HEURISTIC_UNCALIBRATED"


def measure(spark: SparkSession, path: str, white_box: bool = True) -> dict[str, DataFrame]:
    """digests (one row), parts and blocks of the model at a path; a black box has only the digest of its file."""
    files = stored.model_files(spark, path)
    if not white_box:
        digests = stored.file_digests(files).select("model", "file", *(F.lit(None).cast("string").alias(c) for c in ("graph", "parameters")), F.lit("BLACK_BOX").alias("status"), F.lit(None).cast("string").alias("reason"))
        return {"digests": written(digests, "model-digests")}
    parts = written(stored.read_structure(files), "model-parts")
    blocks = written(stored.tensor_blocks(parts), "model-blocks")
    return {"digests": written(stored.model_digests(files, parts, stored.tensor_digests(blocks)), "model-digests"), "parts": parts, "blocks": blocks}


def _named(blocks: DataFrame) -> DataFrame:
    """Blocks as tensors for comparison: a block is named by its tensor and its number."""
    return blocks.where("reason IS NULL").select(F.concat_ws("#", "name", F.col("block").cast("string")).alias("name"), "shape", "values")


def assess_model(
    spark: SparkSession, path: str, reference: str | None = None, behaviour: DataFrame | None = None, reference_behaviour: DataFrame | None = None, triggers: DataFrame | None = None, pairs: DataFrame | None = None,
    separation: float | None = None, white_box: bool = True,
) -> Report:
    """Assesses the model file at path, against a reference file where there is one.

    behaviour, reference_behaviour: (probe, category, probabilities) on one battery; triggers: (trigger, before, after)
    predictions of probes without and with each trigger; pairs: (kind, before, after) predictions that should agree; separation:
    of the activations of the class that triggers lead to.  What was not given, or what a black box does not show, is
    NOT_ASSESSED with its reason in table `not_assessed`, never clean.
    """
    own = measure(spark, path, white_box)
    row = own["digests"].first()
    if row is None or row.file is None:
        raise ValueError(f"{path} holds no model that can be read")
    asset, none = F.lit(f"M-{row.file[:16]}"), F.lit(None).cast("string")
    tables, done, parts, lost = {"digests": own["digests"]}, {}, [], []
    one = lambda d: d.withColumn("model", F.lit("supplied"))
    if reference is not None:
        other = measure(spark, reference, white_box)
        known = models.identity(one(own["digests"]), one(other["digests"]))
        tables |= {"identity": known, "reference_digests": other["digests"]}
        changed = known.where("severity IS NOT NULL")
        parts.append(_finding(changed, "model_identity", "model_substitution", asset, none, F.col("severity"), F.lit(1.0), "DETERMINISTIC"))
        done["model_substitution"] = "SUPPORTED"
    else:
        lost.append(("model_substitution", "no reference was given"))
    if white_box and row.status == "READ":
        tables["layers"] = stored.model_layers(own["parts"])
        odd = model_files.non_finite_findings(own["blocks"].where("reason IS NULL").select(F.lit("supplied").alias("model"), "name", "values"))
        parts.append(_finding(odd, "model_weights", "model_tampering", asset, none, F.col("severity"), F.col("confidence"), "DETERMINISTIC"))
        stats = written(models.tensor_stats(_named(own["blocks"])), "model-stats")
        users = own["parts"].where("kind = 'layer'").select("op_type", "position", F.explode("inputs").alias("tensor")).groupBy("tensor").agg(F.min_by("op_type", "position").alias("op_type"))
        grouped = stats.withColumn("tensor", F.substring_index("name", "#", 1)).join(users, "tensor", "left").withColumn("op_type", F.coalesce("op_type", F.lit("unknown")))
        tables |= {"tensor_stats": stats, "roll_up": model_files.roll_up(grouped), "peer_outliers": models.peer_outliers(grouped.withColumnRenamed("op_type", "peer_group"))}
        done["model_tampering"] = "SUPPORTED"
        if reference is not None and "blocks" in other:
            compared = written(models.compare_tensors(_named(own["blocks"]), _named(other["blocks"])), "model-compared")
            tables |= {"tensors": compared, "concentration": models.change_concentration(compared)}
    elif white_box:
        lost.append(("model_tampering", f"the weights cannot be read: {row.reason or row.status}"))
    else:
        lost.append(("model_tampering", "weights are out of reach"))
    measured = {"agreement": None, "consistency": None}
    if behaviour is not None and reference_behaviour is not None:
        classes = [d.select(F.size("probabilities")).first() for d in (behaviour, reference_behaviour)]
        compared = model_files.compare_where_possible(behaviour, reference_behaviour, tuple(c[0] if c else 0 for c in classes))
        if compared is None:
            both = [spark.createDataFrame([("supplied", c[0] if c else 0, "")], "model string, classes int, battery string") for c in classes]
            unlike = model_files.comparability(*both)
            tables["comparability"] = unlike
            parts.append(_finding(unlike, "model_behaviour", "model_tampering", asset, none, F.col("severity"), F.col("confidence"), "DETERMINISTIC"))
        else:
            tables["behaviour"] = written(compared, "model-behaviour")
            measured["agreement"] = tables["behaviour"].where("category = 'ALL'").first().agreement
        done["model_tampering"] = "SUPPORTED"
    else:
        lost.append(("model_tampering", "behaviour was not compared with a reference"))
    if pairs is not None:
        tables["consistency"] = models.metamorphic_consistency(pairs)
        measured["consistency"] = tables["consistency"].where("kind = 'ALL'").first().consistency
        done.setdefault("model_tampering", "PARTIAL")
    if any(v is not None for v in measured.values()):
        below = model_files.behaviour_findings(spark.createDataFrame([("supplied", measured["agreement"], measured["consistency"])], "model string, agreement double, consistency double"))
        tables["floors"] = written(below, "model-floors")
        parts.append(_finding(tables["floors"], "model_behaviour", "model_tampering", F.concat_ws(":", asset, "kind"), none, F.col("severity"), F.lit(BEHAVIOUR_CONFIDENCE), HEURISTIC))
    if triggers is not None:
        moved = written(models.targeted_transitions(triggers), "model-triggers")
        tables["triggers"] = moved
        hits = moved.where((F.col("success") >= LEAST_SUCCESS) & (F.col("concentration") >= LEAST_CONCENTRATION)).withColumn("model", F.lit("supplied"))
        if separation is not None:
            shape = spark.createDataFrame([("supplied", float(separation))], "model string, separation double")
            tables["corroborations"] = model_files.corroborations(hits, shape)
        parts.append(_finding(hits, "model_trigger", "model_backdoor", F.concat_ws(":", asset, "trigger"), none, F.when(F.col("success") >= 0.8, "HIGH").otherwise("MEDIUM"), F.lit(BACKDOOR_CONFIDENCE), HEURISTIC))
        done["model_backdoor"] = "PARTIAL"
    else:
        lost.append(("model_backdoor", "no triggered probes were given"))
    offers = ["graph", "parameters"] if white_box else []
    offers += ["inference"] if behaviour is not None else []
    offers += ["activations"] if separation is not None else []
    have = spark.createDataFrame([("supplied", c) for c in offers], "model string, capability string")
    missing = model_files.consequences(one(own["digests"]), model_files.restrict(have, white_box))
    said = spark.createDataFrame(lost, "attack_class string, reason string") if lost else spark.createDataFrame([], "attack_class string, reason string")
    tables |= {"not_assessed": said, "out_of_reach": missing.select("capability", "not_assessed")}
    found = parts[0] if parts else _finding(one(own["digests"]).where("false"), "model_identity", CLASSES[0], asset, none, F.lit("INFO"), F.lit(1.0), "DETERMINISTIC")
    for part in parts[1:]:
        found = found.unionByName(part)
    cover = spark.createDataFrame([(c, done.get(c, "NOT_ASSESSED")) for c in CLASSES], "attack_class string, coverage string")
    return Report(written(found, "model-findings"), cover, tables)

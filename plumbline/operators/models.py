"""Model forensics over exported tables: tensors, layers, probes and their predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.findings import sha256
from plumbline.functions.statistics import js_bits

OUTLIER, LEAST_PEERS = 8.0, 6
#: Small-sample factors of the median absolute deviation, for 2 to 9 peers.
MAD_FACTORS = {2: 1.196, 3: 1.495, 4: 1.363, 5: 1.206, 6: 1.200, 7: 1.140, 8: 1.129, 9: 1.107}


def tensor_digest(values: F.Column, dtype: F.Column, shape: F.Column) -> F.Column:
    """Digest of a tensor's values in whole millionths, with dtype and shape ahead; what is not finite has one mark."""
    units = F.transform(values, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(-(2**63))).otherwise(F.bround(x.cast("double") * 1e6).cast("long")))
    return sha256(F.concat_ws("|", dtype, F.concat_ws(",", shape.cast("array<string>")), F.concat_ws(",", units.cast("array<string>"))))


def tensor_stats(tensors: DataFrame) -> DataFrame:
    """tensors (name, values) -> count, mean, std, l1, l2, max_abs, sparsity, kurtosis (excess), beyond_6_sigma, non_finite."""
    values = tensors.select("name", F.explode("values").alias("x")).withColumn("x", F.col("x").cast("double"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    good = values.where(~bad)
    first = good.groupBy("name").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.sum(F.abs("x")).alias("l1"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l2"), F.max(F.abs("x")).alias("max_abs"), F.avg((F.abs("x") < 1e-8).cast("double")).alias("sparsity"))
    centred = good.join(first.select("name", "mean", "std"), "name").withColumn("z", F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))).otherwise(0.0))
    second = centred.groupBy("name").agg((F.avg(F.pow("z", F.lit(4.0))) - 3).alias("kurtosis"), F.avg((F.abs("z") > 6).cast("double")).alias("beyond_6_sigma"))
    return first.join(second, "name").join(values.groupBy("name").agg(F.count_if(bad).alias("non_finite")), "name")


def compare_tensors(supplied: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, shape, values) of both sides -> status (identical, changed, reshaped, only_supplied, only_reference) and sizes of change."""
    both = supplied.select("name", F.col("shape").alias("sa"), F.col("values").alias("va")).join(reference.select("name", F.col("shape").alias("sb"), F.col("values").alias("vb")), "name", "full")
    same_shape = (F.col("sa") == F.col("sb")) & (F.size("va") == F.size("vb"))
    status = F.when(F.col("vb").isNull(), "only_supplied").when(F.col("va").isNull(), "only_reference").when(~same_shape, "reshaped").when(F.col("va") == F.col("vb"), "identical").otherwise("changed")
    delta = F.zip_with("va", "vb", lambda a, b: a.cast("double") - b.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    inner = F.aggregate(F.zip_with("va", "vb", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = both.withColumn("status", status).withColumn("d", F.when(F.col("status") == "changed", delta))
    na, nb = F.sqrt(total(F.col("va"))), F.sqrt(total(F.col("vb")))
    relative = F.when(nb > 1e-12, F.sqrt(total(F.col("d"))) / F.when(nb > 1e-12, nb)).otherwise(float("inf"))
    cosine = F.when(na * nb > 1e-12, inner / F.when(na * nb > 1e-12, na * nb)).otherwise(0.0)
    only = lambda c: F.when(F.col("status") == "changed", F.round(c, 8))
    return rows.select(
        "name", "status",
        F.when(F.col("status") == "changed", F.size(F.filter("d", lambda x: F.abs(x) > 1e-8))).alias("changed_elements"),
        only(F.size(F.filter("d", lambda x: F.abs(x) > 1e-8)) / F.size("d")).alias("changed_fraction"),
        only(F.sqrt(total(F.col("d")))).alias("absolute_l2"), only(relative).alias("relative_l2"), only(F.array_max(F.transform("d", F.abs))).alias("max_absolute"), only(cosine).alias("cosine"),
    )


def change_concentration(compared: DataFrame) -> DataFrame:
    """none, localised (one tensor, or one with over 80 % of the change), distributed (over 3, none with 40 %) or mixed."""
    sums = compared.where("status = 'changed'").agg(F.count("*").alias("n"), F.sum("absolute_l2").alias("all"), F.max("absolute_l2").alias("top"))
    share = F.coalesce(F.try_divide("top", "all"), F.lit(0.0))
    pattern = F.when(F.col("n") == 0, "none").when((F.col("n") == 1) | (share > 0.8), "localised").when((F.col("n") > 3) & (share < 0.4), "distributed").otherwise("mixed")
    return sums.select("n", F.round(share, 6).alias("top_share"), pattern.alias("pattern"))


def peer_outliers(stats: DataFrame, metrics: tuple[str, ...] = ("l2", "max_abs", "kurtosis", "sparsity")) -> DataFrame:
    """stats (name, peer_group, metrics…) -> name, peer_group, metric, value, z of tensors far from their peers' median."""
    rows = stats.select("name", "peer_group", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")).select("name", "peer_group", "m.*")
    key = ["peer_group", "metric"]
    middle = rows.groupBy(*key).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PEERS)
    away = rows.join(middle, key).withColumn("away", F.abs(F.col("value") - F.col("median")))
    spread = away.groupBy(*key).agg(F.percentile("away", F.lit(0.5)).alias("mad"))
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in MAD_FACTORS.items() for v in p)), F.col("n").cast("int")), F.col("n") / (F.col("n") - 0.8))
    z = (F.col("value") - F.col("median")) / F.when(F.col("mad") > 0, F.col("mad") * 1.4826 * factor)
    return away.join(spread, key).withColumn("z", F.round(z, 6)).where(F.abs("z") >= OUTLIER).select("name", *key, "value", "z")


def identity(supplied: DataFrame, reference: DataFrame) -> DataFrame:
    """(model, file, graph, parameters) digests of both sides -> relation and severity."""
    a, b = (d.select("model", *(F.col(c).alias(f"{s}_{c}") for c in ("file", "graph", "parameters"))) for d, s in ((supplied, "s"), (reference, "r")))
    graph, weights = F.col("s_graph") == F.col("r_graph"), F.col("s_parameters") == F.col("r_parameters")
    relation = F.when(F.col("s_file") == F.col("r_file"), "IDENTICAL").when(F.col("s_graph").isNull() | F.col("r_graph").isNull(), "DIFFERENT_BYTES_STRUCTURE_UNAVAILABLE").when(graph & weights, "RESERIALISED").when(graph, "SAME_ARCHITECTURE_DIFFERENT_WEIGHTS").otherwise("DIFFERENT_MODEL")
    severity = {"RESERIALISED": "MEDIUM", "SAME_ARCHITECTURE_DIFFERENT_WEIGHTS": "HIGH", "DIFFERENT_MODEL": "CRITICAL", "DIFFERENT_BYTES_STRUCTURE_UNAVAILABLE": "HIGH"}
    return a.join(b, "model").withColumn("relation", relation).select("model", "relation", F.element_at(F.create_map(*(F.lit(v) for p in severity.items() for v in p)), F.col("relation")).alias("severity"))


def structure_diff(supplied: DataFrame, reference: DataFrame) -> DataFrame:
    """(position, op_type, shape, parameters) of both sides, paired by position: status same, changed, added or removed."""
    a, b = (d.select("position", F.struct("op_type", "shape", "parameters").alias(s)) for d, s in ((supplied, "a"), (reference, "b")))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "position", "full").select("position", status.alias("status"), F.col("a.op_type").alias("supplied_op"), F.col("b.op_type").alias("reference_op"))


def compare_behaviour(a: DataFrame, b: DataFrame) -> DataFrame:
    """(probe, category, probabilities) of two models -> overall (category null) and by category: n, agreement, JS and confidence shift."""
    both = a.select("probe", "category", F.col("probabilities").alias("p")).join(b.select("probe", F.col("probabilities").alias("q")), "probe")
    js = F.aggregate(F.zip_with("p", "q", js_bits), F.lit(0.0), lambda s, x: s + x)
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    rows = both.select("category", (top("p") == top("q")).cast("double").alias("same"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), js)).alias("js"), (F.array_max("p") - F.array_max("q")).alias("shift"))
    sets = rows.groupingSets([[], ["category"]], "category")
    return sets.agg(
        F.count("*").alias("n"), F.round(F.avg("same"), 9).alias("agreement"), F.round(F.avg("js"), 9).alias("js_mean"), F.round(F.percentile("js", F.lit(0.5)), 9).alias("js_median"),
        F.round(F.percentile("js", F.lit(0.95)), 9).alias("js_p95"), F.round(F.max("js"), 9).alias("js_max"), F.round(F.avg("shift"), 9).alias("shift_mean"), F.round(F.avg(F.abs("shift")), 9).alias("shift_mean_abs"),
    ).withColumn("category", F.coalesce("category", F.lit("ALL")))


def targeted_transitions(pairs: DataFrame) -> DataFrame:
    """(trigger, before, after) predictions of pairs -> flips, dominant target (ties: smaller), success over all, concentration."""
    whole = pairs.groupBy("trigger").agg(F.count("*").alias("n"), F.count_if(F.expr("before != after")).alias("flips"))
    hits = pairs.where("before != after").groupBy("trigger", F.col("after").alias("target")).agg(F.count("*").alias("hits"))
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("trigger").orderBy(F.desc("hits"), "target"))).where("k = 1")
    out = whole.join(best, "trigger", "left")
    return out.select("trigger", "n", "flips", "target", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("n"), 9).alias("success"), F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("flips")), F.lit(0.0)), 9).alias("concentration"))


def metamorphic_consistency(pairs: DataFrame) -> DataFrame:
    """(kind, before, after) -> share of equal predictions by kind and over all (kind ALL)."""
    sets = pairs.groupingSets([[], ["kind"]], "kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("before") == F.col("after")).cast("double")), 9).alias("consistency"))
    return sets.withColumn("kind", F.coalesce("kind", F.lit("ALL")))

"""Over-representation of contributors, calibration tables and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.functions.statistics import benjamini_hochberg, binomial_tail, bin_of, wilson_lower

LEAST_SAMPLES, LEAST_FLAGGED, ALPHA = 8, 2, 0.05
#: Edges of the calibration bins.
EDGES = [0.0, 0.25, 0.5, 0.7, 0.85, 0.95, 1.0]


def leave_one_out(rates: DataFrame, within: list[str], default: float) -> DataFrame:
    """rates (…, k, n) with share: flagged over samples of all other rows of the group, or default if there are none."""
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    k, n = F.sum("k").over(whole) - F.col("k"), F.sum("n").over(whole) - F.col("n")
    return rates.withColumn("share", F.when(n > 0, k / F.when(n > 0, n)).otherwise(F.lit(default)))


def over_represented(samples: DataFrame, flags: DataFrame, child_confidence: float, child_severity: str) -> DataFrame:
    """samples (id, contributor), flags (id, attack_class) -> tests of contributors by class with q-values and findings.

    Counts of distinct flagged samples by contributor are small tables; everything after them is on those.
    """
    totals = samples.groupBy("contributor").agg(F.countDistinct("id").alias("n"))
    flagged = samples.join(flags.distinct(), "id").groupBy("contributor", "attack_class").agg(F.countDistinct("id").alias("k"))
    classes = flagged.select("attack_class").distinct()
    rates = totals.crossJoin(F.broadcast(classes)).join(flagged, ["contributor", "attack_class"], "left").fillna(0, ["k"])
    tests = leave_one_out(rates, ["attack_class"], 0.5).where((F.col("n") >= LEAST_SAMPLES) & (F.col("k") >= LEAST_FLAGGED))
    tests = benjamini_hochberg(tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), F.col("share"))), "p", ["attack_class", "contributor"])
    ratio = F.when(F.col("share") > 0, F.col("k") / F.col("n") / F.when(F.col("share") > 0, F.col("share"))).otherwise(float("inf"))
    severity = F.when((F.col("k") >= 15) & (ratio >= 5), "HIGH").when((F.col("k") >= 5) & (ratio >= 3), "MEDIUM").otherwise("LOW")
    severity = F.when(fi.rank(severity) > fi.rank(F.lit(child_severity)), child_severity).otherwise(severity)
    confidence = F.least(1 - F.col("q"), F.lit(child_confidence), F.lit(fi.STATISTICAL_CAP))
    out = tests.withColumn("ratio", ratio).withColumn("severity", severity).withColumn("confidence", confidence)
    return out.withColumn("reported", F.col("q") < ALPHA)


def calibration_table(scored: DataFrame, edges: list[float] = EDGES) -> DataFrame:
    """scored (score, truth 0/1) -> one row for every bin, empty ones too: lower, upper, n, hits, precision, wilson."""
    spark = scored.sparkSession
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lower double, upper double")
    counts = scored.groupBy(bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), F.sum("truth").alias("hits"))
    out = bins.join(counts, "bin", "left").fillna(0, ["n", "hits"])
    precision = F.when(F.col("n") > 0, F.col("hits") / F.when(F.col("n") > 0, F.col("n")))
    return out.select("bin", "lower", "upper", "n", "hits", F.round(precision, 9).alias("precision"), F.round(wilson_lower(F.col("hits"), F.col("n")), 9).alias("wilson"))


def calibrated(scored: DataFrame, table: DataFrame, prior: float) -> DataFrame:
    """scored (score) with confidence from the bin that holds the score, else the capped prior, and its basis."""
    top = table.agg(F.max("upper")).first()[0]
    bins = F.broadcast(table.select("lower", "upper", "wilson"))  # a handful of bins
    inside = (scored["score"] >= bins["lower"]) & ((scored["score"] < bins["upper"]) | (F.lit(top >= 1) & (bins["upper"] == top)))
    out = scored.join(bins, inside, "left")
    return out.withColumn("confidence", F.coalesce("wilson", F.lit(min(prior, fi.HEURISTIC_CAP)))).withColumn("basis", F.when(F.col("wilson").isNotNull(), "CALIBRATED").otherwise("HEURISTIC_UNCALIBRATED")).drop("lower", "upper", "wilson")


def confusion(rows: DataFrame) -> DataFrame:
    """rows (attack_class, predicted, actual, tolerated, clean) -> counts and rates by class.

    Tolerated predictions stay in the denominator of precision but are no false positives.
    """
    tp, fp = F.count_if(F.expr("predicted and actual")), F.count_if(F.expr("predicted and not actual and not tolerated"))
    counts = rows.groupBy("attack_class").agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.expr("not predicted and actual")).alias("fn"), F.count_if(F.expr("predicted")).alias("flagged"), F.count_if(F.expr("clean")).alias("clean_n"), F.count_if(F.expr("clean and predicted")).alias("clean_flagged"), F.count_if(F.expr("not actual")).alias("negatives"))

    def share(a: str, b: F.Column) -> F.Column:
        return F.round(F.when(b > 0, F.col(a) / F.when(b > 0, b)), 9)

    return counts.select(
        "attack_class", "tp", "fp", "fn", "flagged", share("tp", F.col("flagged")).alias("precision"), share("tp", F.col("tp") + F.col("fn")).alias("recall"), share("clean_flagged", F.col("clean_n")).alias("clean_fpr"), share("fp", F.col("negatives")).alias("fpr")
    )


def auroc(rows: DataFrame, by: list[str] | None = None, least: int = 4) -> DataFrame:
    """rows (score, truth 0/1) -> n, positives, auroc (null with one class or fewer than `least` rows).

    Ranks come from counts by distinct score, so only those, and not rows, pass through the window.
    """
    by = by or []
    group = Window.partitionBy(*(by or [F.lit(0)]))
    steps = rows.groupBy(*by, "score").agg(F.count("*").alias("k"), F.sum("truth").alias("pos"))
    below = F.sum(F.col("k") - F.col("pos")).over(group.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    part = F.col("pos") * (F.coalesce(below, F.lit(0)) + (F.col("k") - F.col("pos")) / 2)
    sums = steps.withColumn("part", part).groupBy(*by).agg(F.sum("k").alias("n"), F.sum("pos").alias("positives"), F.sum("part").alias("area"))
    pairs = F.col("positives") * (F.col("n") - F.col("positives"))
    return sums.select(*by, "n", "positives", F.round(F.when((pairs > 0) & (F.col("n") >= least), F.col("area") / F.when(pairs > 0, pairs)), 9).alias("auroc"))

"""Evaluation of detectors over scenarios with known truth: metrics by class, pooled calibration, exact matches, timings."""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.statistics import bin_of, wilson_lower
from plumbline.operators import assessment, contributors


def class_metrics(samples: DataFrame, truth: DataFrame, flagged: DataFrame) -> DataFrame:
    """samples (scenario, id), truth and flagged (scenario, id, attack_class) -> counts and rates by scenario and class.

    Classes that are neither true nor flagged in a scenario have no row; the false positive rate is over samples that no
    class affects.
    """
    key = ["scenario", "id", "attack_class"]
    hits = truth.select(*key).distinct().withColumn("actual", F.lit(True)).join(flagged.select(*key).distinct().withColumn("predicted", F.lit(True)), key, "full").fillna(False)
    dirty = truth.select("scenario", "id").distinct()
    clean = samples.join(dirty, ["scenario", "id"], "left_anti").groupBy("scenario").agg(F.count("*").alias("clean"))
    clean_hits = flagged.select(*key).distinct().join(dirty, ["scenario", "id"], "left_anti").groupBy("scenario", "attack_class").agg(F.count("*").alias("clean_flagged"))
    both = F.col("actual") & F.col("predicted")
    counts = hits.groupBy("scenario", "attack_class").agg(F.count_if(both).alias("tp"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("fp"), F.count_if(F.col("actual") & ~F.col("predicted")).alias("fn"))
    rows = counts.join(clean, "scenario", "left").join(clean_hits, ["scenario", "attack_class"], "left").fillna(0, ["clean", "clean_flagged"])
    share = lambda a, b: F.round(F.try_divide(a, b), 9)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("scenario", "attack_class", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(F.col("clean_flagged"), F.col("clean")).alias("clean_fpr"))


def pooled_calibration(scored: DataFrame, edges: list[float] = contributors.EDGES) -> DataFrame:
    """scored (attack_class, score, truth) of flagged samples of all scenarios -> the calibration table of each class, with empty bins."""
    bins = scored.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lower double, upper double")
    grid = scored.select("attack_class").distinct().crossJoin(F.broadcast(bins))  # a handful of bins
    counts = scored.groupBy("attack_class", bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), F.sum("truth").alias("hits"))
    out = grid.join(counts, ["attack_class", "bin"], "left").fillna(0, ["n", "hits"])
    return out.select("attack_class", "bin", "lower", "upper", "n", "hits", F.round(F.try_divide("hits", "n"), 9).alias("precision"), F.round(wilson_lower(F.col("hits"), F.col("n")), 9).alias("wilson"))


def matched(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """expected, observed (key, value) -> key, expected, observed, matched: pairs of populations by verdict, models by level."""
    e, o = expected.select(key, F.col(value).alias("expected")), observed.select(key, F.col(value).alias("observed"))
    return e.join(o, key, "full").withColumn("matched", F.col("expected").eqNullSafe(F.col("observed")))


def exactly_fired(expected: DataFrame, fired: DataFrame) -> DataFrame:
    """Whether each scenario fired exactly the rules that it should: (scenario, rule) of both sides."""
    return assessment.exact_sets(expected, fired, ["scenario"], "rule")


def timed(work: Callable[[], DataFrame], times: int = 5) -> dict[str, float]:
    """Mean, median and 95th percentile of the seconds that a plan takes to run to its end."""
    seconds = []
    for _ in range(times):
        began = perf_counter()
        work().write.format("noop").mode("overwrite").save()
        seconds.append(perf_counter() - began)
    seconds.sort()
    return {"mean": sum(seconds) / len(seconds), "p50": seconds[len(seconds) // 2], "p95": seconds[min(len(seconds) - 1, int(0.95 * len(seconds)))]}

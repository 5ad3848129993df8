"""Statistics as column expressions and small plans; none of them leaves the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.6448536269514722


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def wilson_lower(hits: Column, trials: Column, z: float = Z95) -> Column:
    """Lower bound of Wilson's interval for a share; 0 without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p = hits / n
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(trials > 0, clip((p + z * z / (2 * n) - margin) / (1 + z * z / n), 0.0, 1.0)).otherwise(0.0)


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number, by Stirling's series at x + 15."""
    z = x + 15
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = reduce(lambda a, b: a + b, (F.log(x + i) for i in range(15)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(hits: Column, trials: Column, share: Column) -> Column:
    """P(X >= hits) of a binomial; the share is kept within [1e-6, 1 - 1e-9], and without trials the answer is 1.

    Terms are summed from hits on the side away from the mean, where they fall: as many as ten standard deviations and a
    constant, so a row of any number of trials sums some tens of thousands of terms at most.
    """
    p = clip(share.cast("double"), 1e-6, 1 - 1e-9)
    k, n = hits.cast("double"), trials.cast("double")
    odds = F.log(p) - F.log1p(-p)
    above = k >= n * p
    from_ = F.when(above, k).otherwise(k - 1)
    most = F.when(above, n - from_).otherwise(from_)
    count = F.least(most, F.ceil(60 + 10 * F.sqrt(n * p * (1 - p)))).cast("int")
    first = log_gamma(n + 1) - log_gamma(from_ + 1) - log_gamma(n - from_ + 1) + from_ * F.log(p) + (n - from_) * F.log1p(-p)
    start = F.struct(F.lit(0.0).alias("total"), first.alias("term"), from_.alias("at"))

    def add(s: Column, _: Column) -> Column:
        at = s["at"]
        up = s["term"] + F.log((n - at) / (at + 1)) + odds
        down = s["term"] + F.log(at / (n - at + 1)) - odds
        more = F.when(above, up).otherwise(down)
        return F.struct((s["total"] + F.exp(s["term"])).alias("total"), F.coalesce(more, F.lit(float("-inf"))).alias("term"), (at + F.when(above, 1.0).otherwise(-1.0)).alias("at"))

    part = F.aggregate(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), start, add, lambda s: F.least(F.lit(1.0), s["total"]))
    return F.when((n <= 0) | (k <= 0), 1.0).when(k > n, 0.0).when(above, part).otherwise(1 - part)


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], out: str = "q") -> DataFrame:
    """tests with q-values over all its rows: one row for each test, so the single window holds tests and not data."""
    whole = Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("__rank", F.row_number().over(whole.orderBy(p, *order))).withColumn("__m", F.count("*").over(whole))
    later = whole.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(later))).drop("__rank", "__m")


def higher_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, the smallest element with at least a share q of the steps below or at it."""
    return F.element_at(values, (F.ceil((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def empirical_p(at_least: Column, n: Column) -> Column:
    return (at_least + 1) / (n + 1)


def bin_of(score: Column, edges: list[float]) -> Column:
    """Index of the bin [edge i, edge i + 1); the last one holds its upper edge and what lies beyond."""
    inner = edges[1:-1]
    return sum(((score >= e).cast("int") for e in inner), F.lit(0))


def js_bits(p: Column, q: Column) -> Column:
    """A category's part of the Jensen-Shannon divergence in bits; 0 log 0 is 0."""
    m = (p + q) / 2
    return sum((F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0) for x in (p, q)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

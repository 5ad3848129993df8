import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.functions import statistics as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_binomial_tail_of_a_rare_share(spark):
    assert one(spark, st.binomial_tail(F.lit(9), F.lit(72), F.lit(0.0))) == pytest.approx(8.511e-44, rel=1e-3)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.3), (5, 0, 0.3), (40, 200, 0.15)])
def test_binomial_tail_matches_the_sum(spark, k, n, p):
    want = 1.0 if n <= 0 or k <= 0 else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert one(spark, st.binomial_tail(F.lit(k), F.lit(n), F.lit(p))) == pytest.approx(want, rel=1e-9)


def test_wilson_without_trials_is_zero(spark):
    assert one(spark, st.wilson_lower(F.lit(0), F.lit(0))) == 0.0
    assert 0.7 < one(spark, st.wilson_lower(F.lit(10), F.lit(10))) < 1.0


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    got = {r.i: r.q for r in st.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", ["i"]).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.2])


def test_higher_quantile_takes_the_upper_neighbour(spark):
    assert one(spark, st.higher_quantile(F.array(*(F.lit(float(i)) for i in range(11))), 0.95)) == 10.0


def test_half_even_units(spark):
    assert one(spark, fi.quantize(F.lit(0.0000025))) == 2


def test_disposition_rules_in_order(spark):
    rows = [("HIGH", 1.0, "DETERMINISTIC", "NOT_ASSESSED"), ("HIGH", 1.0, "DETERMINISTIC", "SUPPORTED"), ("CRITICAL", 0.6, "HEURISTIC_UNCALIBRATED", "SUPPORTED"), ("LOW", 0.3, "STATISTICAL", "SUPPORTED"), ("INFO", 0.9, "STATISTICAL", "SUPPORTED")]
    df = spark.createDataFrame(rows, "s string, c double, b string, v string")
    what, why = fi.disposition(F.col("s"), F.col("c"), F.col("b"), F.col("v"))
    assert [tuple(r) for r in df.select(what, why).collect()] == [("REVIEW", "D-000"), ("QUARANTINE", "D-100"), ("REVIEW", "D-110"), ("REVIEW", "D-200"), ("ACCEPT", "D-900")]


def test_permutation_budget_reaches_the_corrected_level():
    from plumbline.operators.shift import permutation_budget

    assert permutation_budget(23) == 2299
    assert permutation_budget(1) == 999

"""Drift of the distribution of numbers in windows of a stream, by bins of a reference or by mergeable quantile sketches.

Bins serve a reference that is known when the stream starts: a window keeps a count for each bin, and its PSI is exact.
Sketches serve one that is not: a window keeps a few kilobytes for each column, whatever its rows, from which it can later
be compared with any reference, or merged with others to a longer window.  A sketch of size k tells ranks to within about
2.3 / k^0.9 (1.3 % at 200, the usual size; 0.3 % at 1000), so a share of a bin is off by twice that at most.

Bins are closed above, so equal values fall into one bin in either form.  Shares have a floor of half a row.  Nulls and NaN are
no values; a window without values of a column has no row for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.statistics import js_bits
from plumbline.operators.ranks import quantiles
from plumbline.operators.shift import psi_band

SIZE, BINS = 1000, 10


def inner_shares(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def _divergences(p: Column, q: Column, n_p: Column, n_q: Column) -> tuple[Column, Column]:
    """PSI and Jensen-Shannon divergence (bits) of two arrays of shares."""

    def floored(shares: Column, n: Column) -> Column:
        return F.transform(shares, lambda v: F.greatest(v, 1 / (2 * n)))

    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    psi = total(F.zip_with(floored(p, n_p), floored(q, n_q), lambda a, b: (b - a) * F.ln(b / a)))
    return psi, total(F.zip_with(p, q, lambda a, b: js_bits(a, b)))


# ---------------------------------------------------------------- bins


def reference_bins(values: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """One row: the inner edges (exact quantiles of the reference, without repeats), counts by bin, and their sum n."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.lit(0).alias("g"), F.col(value).cast("double").alias("v"))
    edges = quantiles(known, "g", "v", inner_shares(bins), out="q").select(F.array_distinct("q").alias("edges"))
    counts = known.crossJoin(F.broadcast(edges)).groupBy("edges", bin_of("v").alias("bin")).agg(F.count("*").alias("n"))  # edges: one row
    return by_bin(counts, "edges").select("edges", "counts", "n")


def bin_of(value: str) -> Column:
    return F.size(F.filter("edges", lambda e: e < F.col(value)))


def by_bin(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, edges, bin, n (a row for each bin met) -> keys, counts (of every bin in order), n."""
    by = list(dict.fromkeys([*keys, "edges"]))
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"), F.sum("n").alias("n"))  # a few bins
    every = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.try_element_at("held", b), F.lit(0)))
    return held.select(*by, every.alias("counts"), "n")


def window_bins(events: DataFrame, reference: DataFrame, value: str, time: str = "ts", width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """A stream -> counts by tumbling window and bin of the reference (reference_bins), closed by a watermark."""
    edges = F.broadcast(reference.select("edges"))  # one row
    known = events.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withWatermark(time, delay).crossJoin(edges)
    return known.groupBy(F.window(time, width).alias("w"), bin_of(value).alias("bin")).agg(F.count("*").alias("n"))


def bin_drift(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """Closed windows (w, bin, n) against reference_bins() -> start, psi, band, js, n."""
    ref = reference.select("edges", F.col("counts").alias("r"), F.col("n").alias("n_r"))
    rows = by_bin(windows.crossJoin(F.broadcast(ref.select("edges"))), "w").join(F.broadcast(ref.drop("edges")))  # one row
    share = lambda counts, n: F.transform(counts, lambda c: c / F.col(n))
    psi, js = _divergences(share("r", "n_r"), share("counts", "n"), F.col("n_r"), F.col("n"))
    return rows.select(F.col("w.start").alias("start"), F.round(psi, 9).alias("psi"), psi_band(psi).alias("band"), F.round(js, 9).alias("js"), "n")


# ---------------------------------------------------------------- sketches


def _sketches(columns: list[str], size: int) -> list[Column]:
    return [F.kll_sketch_agg_double(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), size).alias(c) for c in columns]


def window_sketches(events: DataFrame, columns: list[str], time: str = "ts", width: str = "1 day", delay: str = "2 hours", size: int = SIZE) -> DataFrame:
    """A stream -> w and a quantile sketch of each column by tumbling window, closed by a watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(*_sketches(columns, size))


def reference_sketch(values: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """One row with a quantile sketch of each column."""
    return values.agg(*_sketches(columns, size))


def merged_windows(windows: DataFrame, columns: list[str], width: str, size: int = SIZE) -> DataFrame:
    """Sketches of short windows -> of longer ones that hold them whole (days -> weeks): no row is read again."""
    longer = F.window(F.col("w.start"), width).alias("w")
    return windows.select(longer, *columns).groupBy("w").agg(*(F.kll_merge_agg_double(c, size).alias(c) for c in columns))


def sketch_drift(windows: DataFrame, reference: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Sketches of windows against those of a reference -> column, start, psi, band, js, n.

    The reference's edges, bins - 1 numbers for each column, come to the driver: ranks are asked for at given numbers.
    """
    wanted = F.array(*map(F.lit, inner_shares(bins)))
    filled = {c: F.kll_sketch_get_n_double(c) > 0 for c in columns}
    edges = reference.select(*(F.when(filled[c], F.array_distinct(F.kll_sketch_get_quantile_double(c, wanted))).alias(c) for c in columns)).first()
    ref = F.broadcast(reference.select(*(F.col(c).alias(f"r_{c}") for c in columns)))  # one row
    rows, parts = windows.join(ref), []

    def shares(sketch: str, at: list[float]) -> Column:
        upto = F.concat(F.kll_sketch_get_rank_double(sketch, F.array(*map(F.lit, at))), F.array(F.lit(1.0)))
        return F.zip_with(upto, F.concat(F.array(F.lit(0.0)), F.slice(upto, 1, len(at))), lambda a, b: a - b)

    for c in columns:
        if edges[c] is None:
            continue  # a reference without values of this column
        cut = rows.where(filled[c]).select(
            F.lit(c).alias("column"), F.col("w.start").alias("start"), F.kll_sketch_get_n_double(c).alias("n"), F.kll_sketch_get_n_double(f"r_{c}").alias("n_r"), shares(f"r_{c}", edges[c]).alias("p"), shares(c, edges[c]).alias("q")
        )
        psi, js = _divergences(F.col("p"), F.col("q"), F.col("n_r"), F.col("n"))
        parts.append(cut.select("column", "start", F.round(psi, 9).alias("psi"), psi_band(psi).alias("band"), F.round(js, 9).alias("js"), "n"))
    none = windows.sparkSession.createDataFrame([], "column string, start timestamp, psi double, band string, js double, n bigint")
    return reduce(DataFrame.unionByName, parts, none)

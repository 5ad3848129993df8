"""Out-of-distribution scores by three methods, cross-fitted over the folds of a reference.

Every fold's model is fitted on the other folds: its mean, principal axes and shrunken covariance come from sums of all folds,
taken in one pass, less the sums of its own.  A reference row is scored by the model that never saw it, every other row by all
models, averaged, so that scores and thresholds come from models of equal size.  Distances to neighbours are taken in the
axes of each model; rows meet block by block, once for all folds.  What the driver holds is FOLDS times the square of the
dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.neighbours import _rows, blocks_of, shrunk_covariance
from plumbline.operators.populations import corrected_rate, outlier_severity
from plumbline.operators.ranks import running_total
from plumbline.sources.shared import written

FOLDS, NEIGHBOURS, COMPONENTS, FALSE_ALARMS = 5, 5, 48, 0.01
METHODS = ("mahalanobis", "knn", "residual")
#: Rows of the reference that meet a tile of rows at a time, rows of a tile, and pairs of a row in a block that are many.
BLOCK_ROWS, TILE_ROWS, CROWDED = 1024, 1024, 64


class FoldModel(NamedTuple):
    """What is fitted on all folds but one."""

    fold: int
    n: int
    mean: np.ndarray
    axes: np.ndarray
    precision: np.ndarray


def assign_folds(points: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, int]:
    """points (id, vector, reference) with fold: the place in the reference's order modulo their number, null for others."""
    n = points.where("reference").count()
    folds = max(2, min(folds, n // 2)) if n >= 4 else 2
    order = running_total(points.where("reference").select("id"), "id", out="place").select("id", F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"))
    return written(points.select("id", "vector", "reference").join(order, "id", "left"), "outlier-folds"), folds


def _sums(rows: DataFrame, width: int, part) -> np.ndarray:
    """rows (fold, vector) -> sum of part(folds, vectors), an array of so many numbers, over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += np.ravel(part(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["at", "value"])

    got = rows.select("fold", "vector").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out


def fit_folds(points: DataFrame, folds: int, components: int = COMPONENTS) -> list[FoldModel]:
    """Models of assign_folds() rows, without those that would be fitted on fewer than three rows."""
    reference = points.where("reference")
    first = reference.select("vector").first()
    if first is None:
        return []
    origin = np.asarray(first.vector, np.float64)
    d = len(origin)
    size = 1 + d + d * d

    def moments(fold: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, size))
        for f in range(folds):
            own = v[fold == f] - origin
            out[f] = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        return out

    sums = _sums(reference, folds * size, moments).reshape(folds, size)
    fitted = []
    for f in range(folds):
        rest = sums.sum(axis=0) - sums[f]
        n, shift = round(rest[0]), rest[1 : 1 + d]
        if n < 3 or not sums[f][0]:
            continue
        products = rest[1 + d :].reshape(d, d) - np.outer(shift, shift) / n
        value, vector = np.linalg.eigh(products)
        value, vector = value[::-1], vector.T[::-1]
        real = int((value > max(1e-24, value[0] * d * np.finfo(float).eps)).sum())
        axes = vector[: max(1, min(components, real, n - 1))]
        fitted.append((f, n, origin + shift / n, axes, products))

    def fourth(fold: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.array([((((v[fold != f] - mean) @ axes.T) ** 2).sum(axis=1) ** 2).sum() for f, _, mean, axes, _ in fitted])

    powers = _sums(reference, len(fitted), fourth) if fitted else []
    return [FoldModel(f, n, mean, axes, np.linalg.inv(shrunk_covariance(axes @ products @ axes.T / n, p, n) + 1e-12 * np.eye(len(axes)))) for (f, n, mean, axes, products), p in zip(fitted, powers, strict=True)]


def subspace_scores(points: DataFrame, models: list[FoldModel]) -> DataFrame:
    """id, mahalanobis, residual of every row, cross-fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = _rows(pa.table({"id": batch.column(0), "vector": batch.column(1)}), "id", "vector")
            if not len(v):
                continue
            fold = batch.column(2).fill_null(-1).to_numpy()
            out, used = np.zeros((2, len(v))), np.zeros(len(v))
            for m in models:
                on = (fold == m.fold) | (fold < 0)
                centred = v[on] - m.mean
                z = centred @ m.axes.T
                out[0, on] += np.einsum("ij,jk,ik->i", z, m.precision, z)
                out[1, on] += np.linalg.norm(centred - z @ m.axes, axis=1)
                used[on] += 1
            out /= np.maximum(used, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1])], ["id", "mahalanobis", "residual"])

    return points.select("id", "vector", "fold").mapInArrow(run, "id long, mahalanobis double, residual double")


def _nearest_distances(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Distances of each row of a to its k nearest rows of b (all, if fewer), in order.

    A product in single precision gives every square, less more than its error can be; only pairs below the nearest so far
    are worked out, from their differences.  Where that leaves many pairs, rows nearly equal, one in double precision follows.
    """
    few = min(k, len(b))
    scale = max(np.abs(a).max(), np.abs(b).max()) or 1.0
    left, right = _sides(a, b, scale, np.float32)
    width = max(BLOCK_ROWS, few)
    space = np.empty(TILE_ROWS * width, np.float32)
    best = np.empty((len(a), few))
    for low in range(0, len(a), TILE_ROWS):
        part, near = a[low : low + TILE_ROWS], best[low : low + TILE_ROWS]
        for start in range(0, len(b), width):
            some = b[start : start + width]
            rough = np.matmul(left[low : low + TILE_ROWS], right[start : start + width].T, out=space[: len(part) * len(some)].reshape(len(part), -1))
            if not start:
                first = np.argpartition(rough, few - 1, axis=1)[:, :few]
                near[:] = np.sort(_squares(part, some, np.repeat(np.arange(len(part)), few), first.ravel()).reshape(-1, few), axis=1)
                np.put_along_axis(rough, first, np.inf, axis=1)
                limit = _limits(near, scale)
            hit = np.flatnonzero(rough.min(axis=1) < limit)
            if not len(hit):
                continue
            pairs = np.flatnonzero(rough[hit] < limit[hit, None])
            if len(pairs) > CROWDED * len(hit):
                q, p = _sides(part[hit], some, scale, np.float64)
                fine = np.where(np.isinf(rough[hit]), np.inf, q @ p.T)
                last = np.partition(fine, min(few, len(some)) - 1, axis=1)[:, min(few, len(some)) - 1] + 8 * (len(p.T) + 2) * len(p.T) * np.finfo(np.float64).eps
                pairs = np.flatnonzero((fine < limit[hit, None]) & (fine <= last[:, None]))
            r, c = np.divmod(pairs, len(some))
            row = np.concatenate([np.repeat(np.arange(len(hit)), few), r])
            square = np.concatenate([near[hit].ravel(), _squares(part, some, hit[r], c)])
            order = np.lexsort((square, row))
            near[hit] = square[order][np.searchsorted(row[order], np.arange(len(hit)))[:, None] + np.arange(few)]
            limit[hit] = _limits(near[hit], scale)
    return np.sqrt(best)


def _sides(a: np.ndarray, b: np.ndarray, scale: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is the squared distances of rows, in units of scale, less more than its error can be."""
    d = a.shape[1]
    less = 1 - 2 * (d + 4) * np.finfo(kind).eps
    left, right = np.ones((len(a), d + 2), kind), np.ones((len(b), d + 2), kind)
    left[:, :d], right[:, :d] = a / (-scale / 2), b / scale
    left[:, d], right[:, d + 1] = ((a / scale) ** 2).sum(axis=1) * less, ((b / scale) ** 2).sum(axis=1) * less
    return left, right


def _squares(a: np.ndarray, b: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows."""
    return np.concatenate([np.zeros(0), *(((a[row[e : e + 8192]] - b[at[e : e + 8192]]) ** 2).sum(axis=1) for e in range(0, len(row), 8192))])


def _limits(near: np.ndarray, scale: float) -> np.ndarray:
    """What a pair's rough square must be below to come among the nearest; nothing is nearer than a distance of zero."""
    last = near[:, -1]
    return np.where(last > 0, np.nextafter((last / scale / scale + 1e-36).astype(np.float32), np.float32(np.inf)), np.float32(-np.inf))


def neighbour_scores(points: DataFrame, models: list[FoldModel], k: int = NEIGHBOURS) -> DataFrame:
    """id, knn: mean distance to the k nearest rows that a model was fitted on, in its axes, cross-fitted.

    A cell holds a block of all rows and a block of the reference, as large as blocks_of() lets them be; both are projected
    there for every fold, and k distances of each row and fold leave it.
    """
    counts = blocks_of(points, points.where("reference"))
    session, cells = points.sparkSession, counts[0] * counts[1]
    # More partitions than cells, so that no task gets many of them while others get none.
    parts = min(4 * cells, max(32 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    block = [F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in counts]
    left = points.select(F.col("id").alias("query"), F.col("vector").alias("q"), F.col("fold").alias("qf"), block[0].alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("bp"))
    right = points.where("reference").select(F.col("id").alias("point"), F.col("vector").alias("p"), F.col("fold").alias("pf"), block[1].alias("bp"), F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))).alias("bq"))

    def near(q: pa.Table, p: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if q.num_rows and p.num_rows:
            ids, qv = _rows(q, "query", "q")
            _, pv = _rows(p, "point", "p")
            qf, pf = q["qf"].fill_null(-1).to_numpy(), p["pf"].to_numpy()
            for m in models:
                ask, fitted = np.flatnonzero((qf == m.fold) | (qf < 0)), pv[pf != m.fold]
                if not len(ask) or not len(fitted):
                    continue
                best = _nearest_distances((qv[ask] - m.mean) @ m.axes.T, (fitted - m.mean) @ m.axes.T, k)
                out[0].append(np.repeat(ids[ask], best.shape[1]))
                out[1].append(np.full(best.size, m.fold, np.int32))
                out[2].append(best.ravel())
        kinds = (np.int64, np.int32, np.float64)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, t) for n, x, t in zip(("query", "model", "distance"), out, kinds, strict=True)})

    left, right = (d.repartition(parts, "bq", "bp") for d in (left, right))
    found = left.groupBy("bq", "bp").cogroup(right.groupBy("bq", "bp")).applyInArrow(near, "query long, model int, distance double")
    place = F.row_number().over(Window.partitionBy("query", "model").orderBy("distance"))
    means = found.withColumn("place", place).where(F.col("place") <= k).groupBy("query", "model").agg(F.avg("distance").alias("distance"))
    return means.groupBy(F.col("query").alias("id")).agg(F.avg("distance").alias("knn"))


def judge(scores: DataFrame, rate: float) -> DataFrame:
    """scores (id, method, score, reference) with threshold (the higher quantile of the reference's), p and exceeded."""
    n = scores.groupBy("method").agg(F.count_if(F.expr("reference")).alias("n_reference"))
    steps = scores.groupBy("method", "score").agg(F.count_if(F.expr("reference")).alias("k"))
    ranked = written(running_total(steps, "score", "k", within="method", descending=True, out="at_least"), "outlier-ranks").join(n, "method")  # a row for each method
    wanted = F.ceil((F.col("n_reference") - 1) * F.lit(1 - rate)) + 1
    reached = (F.col("k") > 0) & (F.col("n_reference") - F.col("at_least") + F.col("k") >= wanted)
    limits = ranked.groupBy("method").agg(F.min(F.when(reached, F.col("score"))).alias("threshold"))
    out = scores.join(ranked.select("method", "score", "at_least", "n_reference"), ["method", "score"]).join(limits, "method")
    return out.select("id", "method", "score", "reference", "threshold", ((F.col("at_least") + 1) / (F.col("n_reference") + 1)).alias("p"), (F.col("score") > F.col("threshold")).alias("exceeded"))


def combined_outliers(points: DataFrame, declared: bool, rate: float = FALSE_ALARMS, folds: int = FOLDS) -> DataFrame:
    """points (id, vector, reference) -> id, reference, scores, thresholds and p of METHODS, exceeded, min_p, score, flagged, severity.

    A row is flagged if any method exceeds its threshold; the rate is shared by the methods, so that it is that of a false alarm
    of all.  Severity needs the agreement of all methods.  declared: whether the reference was given rather than the rows
    themselves.  A reference too small for a model gives no rows.
    """
    dealt, folds = assign_folds(points, folds)
    models = fit_folds(dealt, folds)
    kinds = ", ".join(f"{m} double, {m}_threshold double, {m}_p double" for m in METHODS)
    if not models:
        return points.sparkSession.createDataFrame([], f"id long, reference boolean, {kinds}, exceeded array<string>, min_p double, score double, flagged boolean, severity string")
    both = dealt.select("id", "reference").join(subspace_scores(dealt, models), "id").join(neighbour_scores(dealt, models), "id")
    long = written(both.select("id", "reference", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("score")) for m in METHODS))).alias("s")).select("id", "reference", "s.*"), "outlier-scores")
    wide = []
    for m in METHODS:
        here = F.col("method") == m
        wide += [F.max(F.when(here, F.col(c))).alias(name) for c, name in (("score", m), ("threshold", f"{m}_threshold"), ("p", f"{m}_p"))]
    rows = judge(long, corrected_rate(rate, len(METHODS))).groupBy("id", "reference").agg(*wide, F.array_sort(F.collect_set(F.when(F.col("exceeded"), F.col("method")))).alias("exceeded"), F.min("p").alias("min_p"))
    rows = written(rows, "outliers-judged")
    graded = outlier_severity(rows.select("id", F.size("exceeded").alias("exceeded"), "min_p"), len(METHODS), declared).select("id", "severity")
    flagged = F.size("exceeded") > 0
    out = rows.join(graded, "id", "left").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("min_p"))))
    return out.select("id", "reference", *(c for m in METHODS for c in (m, f"{m}_threshold", f"{m}_p")), "exceeded", "min_p", "score", flagged.alias("flagged"), F.when(flagged, F.col("severity")).alias("severity"))

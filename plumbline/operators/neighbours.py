"""k nearest neighbours, label consistency and out-of-distribution scores over vectors.

Neighbours are exact: rows are dealt to blocks, every pair of blocks is one task of a matrix product, and only k rows of
each query leave a task.  No block is broadcast, so the corpus may grow; the work is that of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.statistics import dot
from plumbline.operators.ranks import running_total
from plumbline.sources.shared import written

#: Points that meet a tile of queries at a time, queries of a tile, and numbers of a block of either side.
BLOCK_ROWS, TILE_ROWS, CELL_NUMBERS = 4096, 512, 4_000_000


def _rows(table: pa.Table, id_col: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    ids = table[id_col].to_numpy()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[vector].chunks]) if len(ids) else np.zeros(0)
    return ids, flat.astype(np.float64).reshape(len(ids), -1)


def nearest(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """queries, points (id, vector) -> query, point, value of the k nearest other points: cosine (largest) or distance.

    Ties go to the smaller id.  Either side may bring a column apart (array<long>): a query and a point that share an entry are
    not neighbours, and leave their places to others.
    """
    queries, points = (d if "apart" in d.columns else d.withColumn("apart", F.array().cast("array<long>")) for d in (queries, points))
    counts = blocks_of(queries, points)
    left = queries.select(F.col("id").alias("query"), F.col("vector").alias("q"), F.col("apart").alias("qa"), F.pmod(F.xxhash64("id"), F.lit(counts[0])).cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("bp"))
    right = points.select(F.col("id").alias("point"), F.col("vector").alias("p"), F.col("apart").alias("pa"), F.pmod(F.xxhash64("id"), F.lit(counts[1])).cast("int").alias("bp"), F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))).alias("bq"))
    cosine = metric == "cosine"

    def best(q: pa.Table, p: pa.Table) -> pa.Table:
        out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float64)]
        if q.num_rows and p.num_rows:
            qi, qv = _rows(q, "query", "q")
            pi, pv = _rows(p, "point", "p")
            order = np.argsort(pi, kind="stable")
            pi, pv = pi[order], pv[order]
            lists, own = p["pa"].to_pylist(), q["qa"].to_pylist()
            mates: list[dict[int, list[int]]] = [{} for _ in range(0, len(pi), BLOCK_ROWS)]
            for i, j in enumerate(order.tolist()):
                for g in lists[j] or ():
                    mates[i // BLOCK_ROWS].setdefault(g, []).append(i % BLOCK_ROWS)
            if cosine:
                qv, pv = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (qv, pv))
            square = (pv**2).sum(axis=1)
            for low in range(0, len(qi), TILE_ROWS):
                ids, part, groups = qi[low : low + TILE_ROWS], qv[low : low + TILE_ROWS], own[low : low + TILE_ROWS]
                size = (part**2).sum(axis=1)[:, None]
                row, at, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the nearest so far, in order
                limit = np.full(len(ids), np.inf)
                for n, start in enumerate(range(0, len(pi), BLOCK_ROWS)):
                    some = slice(start, start + BLOCK_ROWS)
                    rough = part @ pv[some].T
                    np.multiply(rough, -1 if cosine else -2, out=rough)
                    slack = 1e-12 if cosine else 1e-12 * (size + square[some].max())
                    if not cosine:
                        rough += size + square[some]
                    rough[ids[:, None] == pi[some]] = np.inf
                    for i, mine in enumerate(groups):
                        for g in mine or ():
                            rough[i, mates[n].get(g, [])] = np.inf
                    if np.isinf(limit).any() and rough.shape[1] >= k:
                        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                    r, c = np.nonzero((rough <= limit[:, None] + slack) & np.isfinite(rough))
                    if not len(r):
                        continue
                    # Values proper are worked out pair by pair, so that equal vectors are equally near.
                    exact = np.concatenate([_pairwise(part[r[e : e + 8192]], pv[start + c[e : e + 8192]], cosine) for e in range(0, len(r), 8192)])
                    row, at, value = np.concatenate([row, r]), np.concatenate([at, start + c]), np.concatenate([value, exact])
                    order = np.lexsort((at, value, row))
                    row, at, value = row[order], at[order], value[order]
                    first = np.searchsorted(row, np.arange(len(ids)))
                    kept = np.arange(len(row)) - first[row] < k
                    row, at, value = row[kept], at[kept], value[kept]
                    full = np.flatnonzero(np.bincount(row, minlength=len(ids)) == k)
                    last = np.searchsorted(row, full, side="right") - 1
                    limit[full] = value[last]
                out[0].append(ids[row])
                out[1].append(pi[at])
                out[2].append(-value if cosine else np.sqrt(value))
        return pa.table({n: np.concatenate(x) for n, x in zip(("query", "point", "value"), out, strict=True)})

    cells = left.groupBy("bq", "bp").cogroup(right.groupBy("bq", "bp")).applyInArrow(best, "query long, point long, value double")
    by = F.desc("value") if cosine else F.asc("value")
    return cells.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(by, "point"))).where(F.col("place") <= k)


def _pairwise(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Minus the products, or the squared distances, of rows."""
    return -np.einsum("ij,ij->i", a, b) if cosine else ((a - b) ** 2).sum(axis=1)


def blocks_of(queries: DataFrame, points: DataFrame) -> tuple[int, int]:
    """Numbers of blocks: as few as hold CELL_NUMBERS numbers each, since rows travel once for each block of the other side and
    leave k rows for each block of points; and so many that all cores have cells where there is work."""
    sizes = [d.agg(F.count("*"), F.max(F.size("vector"))).first() for d in (queries, points)]
    least = [max(1, math.ceil(n * (width or 1) / CELL_NUMBERS)) for n, width in sizes]
    cells = 4 * queries.sparkSession.sparkContext.defaultParallelism
    wanted = math.ceil(cells / least[1])
    return max(least[0], min(wanted, math.ceil(sizes[0][0] / TILE_ROWS))), least[1]


def label_consistency(points: DataFrame, groups: DataFrame | None = None, k: int = 10, least: float = 0.70, support: int = 8) -> DataFrame:
    """points (id, label, vector) -> id, label, disagreement, suggested, margin, severity, flagged.

    Classes with fewer than `support` rows stay out.  groups (id, mate) or (id, group) names rows that are no evidence for
    each other, members of a sample's own duplicate groups: they are left out before the nearest k are taken.  Votes weigh 1 / (1 - cosine + 1e-6); ties go to the smaller label.
    """
    good = points.join(points.groupBy("label").count().where(F.col("count") >= support).select("label"), "label", "left_semi")
    ask = points_of = good.select("id", "vector")
    if groups is not None and "group" in groups.columns:
        ask = points_of = ask.join(groups.groupBy("id").agg(F.collect_set("group").alias("apart")), "id", "left")
    elif groups is not None:
        mates = groups.groupBy(F.col("mate").alias("id")).agg(F.collect_set("id").alias("apart"))
        ask, points_of = ask.withColumn("apart", F.array("id")), points_of.join(mates, "id", "left")
    near = nearest(ask, points_of, k)
    labels = good.select(F.col("id").alias("point"), F.col("label").alias("vote"))
    votes = near.join(labels, "point").groupBy("query", "vote").agg(F.sum(1 / (1 - F.col("value") + 1e-6)).alias("w"))
    total = votes.join(good.select(F.col("id").alias("query"), "label"), "query").groupBy("query", "label").agg(
        F.sum("w").alias("all"), F.coalesce(F.sum(F.when(F.col("vote") == F.col("label"), F.col("w"))), F.lit(0.0)).alias("own"), F.min_by("vote", F.struct(-F.col("w"), "vote")).alias("suggested")
    )
    scored = total.withColumn("disagreement", 1 - F.col("own") / F.col("all"))
    # Centroids: a row for each class, whatever the corpus.
    units = good.select("label", F.posexplode("vector").alias("i", "x"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("norm"))
    means = units.groupBy("label", "i").agg(F.avg(F.col("x") / F.col("norm")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    centroids = F.broadcast(means)
    cosine = lambda c: dot(F.col("vector"), F.col(c)) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col(c), F.col(c)))
    whole = scored.join(good.select(F.col("id").alias("query"), "vector"), "query").join(centroids.select("label", F.col("c").alias("c_own")), "label").join(centroids.select(F.col("label").alias("suggested"), F.col("c").alias("c_new")), "suggested")
    d, m = F.col("disagreement"), F.col("margin")
    severity = F.when((d >= 0.9) & (m > 0), "HIGH").when((d >= 0.8) | (d >= 0.7) & (m > 0), "MEDIUM").otherwise("LOW")
    return whole.withColumn("margin", cosine("c_new") - cosine("c_own")).select(F.col("query").alias("id"), "label", "disagreement", "suggested", "margin", severity.alias("severity"), (d >= least).alias("flagged"))


def flag_by_reference(scores: DataFrame, rate: float) -> DataFrame:
    """scores (id, score, reference) -> with threshold (the higher quantile of the reference's scores), p and flagged.

    Ranks are counted over distinct reference scores.
    """
    n = scores.agg(F.count_if(F.expr("reference")).alias("n_reference"))  # one row
    steps = scores.groupBy("score").agg(F.count_if(F.expr("reference")).alias("k"))
    at_least = written(running_total(steps, "score", "k", descending=True, out="at_least"), "score-ranks")
    wanted = F.ceil((F.col("n_reference") - 1) * F.lit(1 - rate)) + 1
    reached = (F.col("k") > 0) & (F.col("n_reference") - F.col("at_least") + F.col("k") >= wanted)
    limit = at_least.crossJoin(F.broadcast(n)).agg(F.min(F.when(reached, F.col("score"))).alias("threshold"), F.max("n_reference").alias("n_reference"))
    out = scores.join(at_least.drop("k"), "score").crossJoin(F.broadcast(limit))  # one row
    return out.withColumn("p", (F.col("at_least") + 1) / (F.col("n_reference") + 1)).withColumn("flagged", F.col("score") > F.col("threshold")).drop("at_least")


def ood_neighbour_scores(points: DataFrame, folds: int = 5, k: int = 5) -> DataFrame:
    """points (id, vector, reference) -> id, reference, score: mean distance to k reference rows, cross-fitted.

    Fold = position in reference order modulo the number of folds.  A reference row is scored by the other folds' rows; a
    candidate by each fold's fitting rows, averaged.
    """
    order = running_total(points.where("reference").select("id", "vector"), "id", out="place")
    reference = written(order.select("id", "vector", F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold")), "folds")
    rest = points.where("not reference").select("id", "vector")
    parts = []
    for f in range(folds):
        fitted = reference.where(F.col("fold") != f).select("id", "vector")
        ask = reference.where(F.col("fold") == f).select("id", "vector").union(rest)
        parts.append(nearest(ask, fitted, k, "euclidean").groupBy("query").agg(F.avg("value").alias("score")))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.union(part)
    return scores.groupBy(F.col("query").alias("id")).agg(F.avg("score").alias("score")).join(points.select("id", "reference"), "id")


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """rows (vector) -> the sum of what part gives for matrices of rows; only that many numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = np.ravel(part(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    got = rows.select("vector").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(got, key=lambda r: r.at)])


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """rows (vector) -> their number, mean, and sums of centred products, over all rows."""
    first = summed(rows, lambda v: np.append(v.sum(axis=0), len(v)))
    mean = first[:-1] / first[-1]
    return int(first[-1]), mean, summed(rows, lambda v: (v - mean).T @ (v - mean)).reshape(len(mean), -1)


def ood_subspace_scores(points: DataFrame, components: int = 48) -> DataFrame:
    """points (id, vector, reference) -> id, reference, residual, mahalanobis.

    Mean, principal axes (signs fixed by the largest entry) and a shrunken covariance come from sums over all rows of the
    reference; every row is scored.
    """
    reference = points.where("reference")
    n, mean, products = moments(reference)
    value, vector = np.linalg.eigh(products)
    value, vector = value[::-1], vector.T[::-1]
    axes = vector[: min(components, int((value > max(1e-24, value[0] * len(value) * np.finfo(float).eps)).sum()), max(1, n - 1))]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    fourth = summed(reference, lambda v: np.array([((((v - mean) @ axes.T) ** 2).sum(axis=1) ** 2).sum()]))[0]
    inverse = np.linalg.inv(shrunk_covariance(axes @ products @ axes.T / n, fourth, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = _rows(pa.table({"id": batch.column(0), "vector": batch.column(1)}), "id", "vector")
            if len(v):
                z = (v - mean) @ axes.T
                residual = np.linalg.norm(v - mean - z @ axes, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(residual), pa.array(np.einsum("ij,jk,ik->i", z, inverse, z))], ["id", "reference", "residual", "mahalanobis"])

    return points.select("id", "vector", "reference").mapInArrow(run, "id long, reference boolean, residual double, mahalanobis double")


def shrunk_covariance(s: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """Covariance s of n rows, shrunk towards a multiple of the identity, with the weight of Ledoit and Wolf (2004).

    fourth is the sum of the fourth powers of the centred rows' lengths.
    """
    d = len(s)
    mu = np.trace(s) / d
    spread = ((s - mu * np.eye(d)) ** 2).sum() / d
    noise = (fourth / n - (s**2).sum()) / d / n
    weight = min(noise, spread) / spread if spread > 0 else 1.0
    return (1 - weight) * s + weight * mu * np.eye(d)


def systematic_pairs(units: DataFrame, least_contributor: int = 10, least_pair: int = 4) -> DataFrame:
    """units (contributor, label, suggested, flagged) -> tests of (contributor, label, suggested) with p and leave-one-out share."""
    from plumbline.functions.statistics import benjamini_hochberg, binomial_tail

    totals = units.groupBy("contributor").agg(F.count("*").alias("n"))
    pairs = units.where("flagged and label != suggested").groupBy("contributor", "label", "suggested").agg(F.count("*").alias("k"))
    everyone = totals.agg(F.sum("n").alias("all_n"))
    by_pair = Window.partitionBy("label", "suggested")
    rows = pairs.join(totals, "contributor").crossJoin(F.broadcast(everyone)).withColumn("others_k", F.sum("k").over(by_pair) - F.col("k")).withColumn("others_n", F.col("all_n") - F.col("n"))
    share = F.when(F.col("others_n") > 0, F.col("others_k") / F.when(F.col("others_n") > 0, F.col("others_n"))).otherwise(F.col("k") / F.col("n") * 0.5)
    tests = rows.withColumn("share", share).where((F.col("n") >= least_contributor) & (F.col("k") >= least_pair))
    return benjamini_hochberg(tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), F.col("share"))), "p", ["contributor", "label", "suggested"])

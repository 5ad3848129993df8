"""Activation forensics of probes by predicted class: sums over all probes of a class, of which only moments reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written

LEAST_PROBES, TOP_SHARE, ROUNDS, BLOCK_ROWS = 12, 0.15, 50, 4096


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sums(rows: DataFrame, part: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """rows (predicted, vector) -> by class, the sum of what part gives for matrices of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                kinds, v = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(1))
                for c in np.unique(kinds).tolist():
                    totals[c] = totals.get(c, 0) + np.ravel(part(c, v[kinds == c]))
        for c, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(total), pa.int64()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, pa.float64())], ["predicted", "at", "value"])

    got: dict[int, list] = {}
    for r in rows.mapInArrow(run, "predicted long, at int, value double").groupBy("predicted", "at").agg(F.sum("value").alias("value")).collect():
        got.setdefault(r.predicted, []).append((r.at, r.value))
    return {c: np.array([x for _, x in sorted(v)]) for c, v in got.items()}


def _projected(probes: DataFrame, components: int) -> DataFrame:
    """probe, predicted, z (coordinates along the class's top directions) of every probe of a class with enough of them."""
    rows = probes.select(F.col("predicted").cast("long").alias("predicted"), F.col("activation").alias("vector"))
    first = {c: s for c, s in _sums(rows, lambda c, v: np.append(v.sum(axis=0), len(v))).items() if s[-1] >= LEAST_PROBES}
    mean = {c: s[:-1] / s[-1] for c, s in first.items()}
    products = _sums(rows, lambda c, v: (v - mean[c]).T @ (v - mean[c]) if c in mean else np.zeros(0))
    axes = {c: np.linalg.eigh(products[c].reshape(len(m), -1))[1][:, ::-1][:, :components] for c, m in mean.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(kinds).tolist():
                if c in mean:
                    part = batch.filter(pa.array(kinds == c))
                    z = (_vectors(part.column(2)) - mean[c]) @ axes[c]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(z), pa.list_(pa.float64()))], ["probe", "predicted", "z"])

    kept = probes.select(F.col("probe").cast("long").alias("probe"), F.col("predicted").cast("long").alias("predicted"), "activation")
    return written(kept.mapInArrow(run, "probe long, predicted long, z array<double>"), "projected")


def spectral(probes: DataFrame) -> DataFrame:
    """probes (probe, predicted, activation) -> by class with enough probes: score along the top direction, whether among the
    highest TOP_SHARE, and the ratio of their mean score to that of the others."""
    scores = _projected(probes, 1).select("probe", "predicted", (F.get("z", F.lit(0)) ** 2).alias("score"))
    sizes = scores.groupBy("predicted").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("predicted").orderBy(F.desc("score"), "probe"))
    ranked = scores.withColumn("place", place).join(F.broadcast(sizes), "predicted")  # a row for each class
    ranked = ranked.select("probe", "predicted", "score", (F.col("place") <= F.ceil(F.col("n") * TOP_SHARE)).alias("flagged"))
    top, rest = (F.avg(F.when(F.col("flagged") == x, F.col("score"))) for x in (True, False))
    ratio = ranked.groupBy("predicted").agg(F.when(rest > 0, top / rest).otherwise(float("inf")).alias("separation"))
    return ranked.join(F.broadcast(ratio), "predicted").select("probe", "predicted", "score", "flagged", "separation")  # a row for each class


def _near(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((z[:, None] - centre[None]) ** 2).sum(-1).argmin(1)


def two_clusters(probes: DataFrame, components: int = 10) -> DataFrame:
    """By class: sizes of two clusters of the projected activations, the smaller one's share, and the silhouette.

    A round of the clustering is an aggregation; the silhouette sums distances block against block, over all pairs of a class.
    """
    z = _projected(probes, components)
    rows, by = z.select("predicted", "z"), F.struct(F.get("z", F.lit(0)), "probe")
    ends = z.groupBy("predicted").agg(F.min_by("z", by).alias("low"), F.max_by("z", F.struct(F.get("z", F.lit(0)), -F.col("probe"))).alias("high")).collect()
    centre = {r.predicted: np.array([r.low, r.high]) for r in ends}
    moving, counts = set(centre), {}

    def part(c: int, v: np.ndarray) -> np.ndarray:
        near = _near(v, centre[c])
        return np.concatenate([np.append(v[near == k].sum(axis=0), (near == k).sum()) for k in (0, 1)])

    for left in reversed(range(ROUNDS)):
        for c, s in _sums(rows.where(F.col("predicted").isin(*moving)), part).items() if moving else ():
            s = s.reshape(2, -1)
            counts[c] = s[:, -1]
            new = s[:, :-1] / np.maximum(s[:, -1:], 1)
            if (s[:, -1] == 0).any() or np.allclose(new, centre[c]) or not left:
                moving.discard(c)
            else:
                centre[c] = new

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(2))
                near = np.concatenate([_near(x[None], centre[c]) for c, x in zip(batch.column(1).to_pylist(), v, strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["probe", "predicted", "z", "cluster"])

    kind = "probe long, predicted long, z array<double>, cluster int"
    blocks = {c: int(-(-n.sum() // BLOCK_ROWS)) for c, n in counts.items()}
    of = z.sparkSession.createDataFrame([(c, b) for c, b in blocks.items()], "predicted long, blocks int")
    dealt = written(z.mapInArrow(assign, kind), "assigned").join(F.broadcast(of), "predicted").withColumn("block", F.pmod(F.xxhash64("probe"), F.col("blocks")).cast("int"))  # a row for each class
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("predicted", "block", every.alias("other"), "probe", "z", "cluster")
    b = dealt.select(F.col("predicted").alias("p"), every.alias("at"), F.col("block").alias("of"), F.col("z").alias("z_b"), F.col("cluster").alias("side"))

    def distances(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            p, q = (_vectors(t.combine_chunks()) for t in (x["z"], y["z_b"]))
            side = y["side"].to_numpy()
            for low in range(0, len(p), 256):
                far = np.sqrt(((p[low : low + 256, None] - q[None]) ** 2).sum(-1))
                out.append(np.stack([far[:, side == k].sum(axis=1) for k in (0, 1)], axis=1))
        total = np.concatenate(out) if out else np.zeros((0, 2))
        kept = x.slice(0, len(total))
        return pa.table({"predicted": kept["predicted"], "probe": kept["probe"], "cluster": kept["cluster"], "d0": total[:, 0], "d1": total[:, 1]})

    far = a.groupBy("predicted", "block", "other").cogroup(b.groupBy("p", "at", "of")).applyInArrow(distances, "predicted long, probe long, cluster int, d0 double, d1 double")
    far = far.groupBy("predicted", "probe", "cluster").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    held = z.sparkSession.createDataFrame([(c, int(n[0]), int(n[1])) for c, n in counts.items()], "predicted long, n0 long, n1 long")
    rows = far.join(F.broadcast(held), "predicted")  # a row for each class
    first = F.col("cluster") == 0
    own = F.when(first, F.col("d0") / F.greatest(F.lit(1), F.col("n0") - 1)).otherwise(F.col("d1") / F.greatest(F.lit(1), F.col("n1") - 1))
    other = F.when(first, F.try_divide("d1", "n1")).otherwise(F.try_divide("d0", "n0"))
    value = (other - own) / F.greatest(own, other, F.lit(1e-12))
    n = F.col("n0") + F.col("n1")
    return rows.groupBy("predicted", n.alias("n"), (F.least("n0", "n1") / n).alias("minority_share")).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def coincidence(flagged: DataFrame, triggers: DataFrame) -> DataFrame:
    """Precision and recall of flagged probes against trigger probes; null against an empty set."""
    both = flagged.select("probe").distinct().join(triggers.select("probe").distinct(), "probe").agg(F.count("*").alias("hits"))
    sizes = flagged.agg(F.count_distinct("probe").alias("n")).crossJoin(triggers.agg(F.count_distinct("probe").alias("m")))  # one row each
    return both.crossJoin(sizes).select("hits", "n", "m", F.try_divide("hits", "n").alias("precision"), F.try_divide("hits", "m").alias("recall"))

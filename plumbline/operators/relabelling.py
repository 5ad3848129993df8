"""Random relabellings of pooled rows, shared by the tests that draw a null from them.

A relabelling is an order of the rows by a hash of (seed, replicate, id): the first n are the reference, so any engine draws the
same ones, and metrics with the same seed share them.  Rows are neither copied nor sorted: inside an Arrow batch, the keys of
all replicates mark which rows surely come before the n-th, and the marks times the rows' values are sums for all
replicates at once.  Only the few rows whose keys lie near the expected place of the n-th leave the batch and are ranked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written

#: Half width of the strip that is ranked, in standard deviations of the n-th key; labels whose sums a task holds.
DEVIATIONS, HELD_LABELS = 8.0, 10_000
PART = "replicate int, label string, ranked boolean, key binary, id string, x array<double>"
_KINDS = [pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.list_(pa.float64())]
_NAMES = [c.split()[0] for c in PART.split(", ")]


def keys(ids: list[str], count: int, seed: str) -> list[list[bytes]]:
    """For each replicate from 1 on, sha256 of seed|replicate|id of every id."""
    data = [i.encode() for i in ids]
    out = []
    for b in range(1, count + 1):
        begun = hashlib.sha256(f"{seed}|{b}|".encode())
        row = []
        for one in data:
            h = begun.copy()
            h.update(one)
            row.append(h.digest())
        out.append(row)
    return out


def _parts(rows: DataFrame, low: float, high: float, count: int, seed: str) -> DataFrame:
    bounds = [min(max(int(x * 2.0**64), 0), 2**64 - 1) for x in (low, high)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for label, held in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((range(1, count + 1), [label] * count, [False] * count, [None] * count, [None] * count, list(held)), _KINDS, strict=True)], _NAMES)
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            whole = keys(ids, count, seed)
            heads = np.stack([np.frombuffer(b"".join(k[:8] for k in row), ">u8") for row in whole])
            before = heads < np.uint64(bounds[0])
            near = ~before & (heads <= np.uint64(bounds[1]))
            places: dict[str | None, list[int]] = {}
            for k, label in enumerate(labels):
                places.setdefault(label, []).append(k)
            for label, at in places.items():
                more = before[:, at].astype(np.float64) @ x[at]
                sums[label] = sums[label] + more if label in sums else more
            replicate, row = np.nonzero(near)
            if len(row):
                found = zip(replicate.tolist(), row.tolist(), strict=True)
                columns = zip(*((b + 1, labels[k], True, whole[b][k], ids[k], x[k]) for b, k in found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)
            if len(sums) > HELD_LABELS:
                yield from flush()
        yield from flush()

    return rows.select(F.col("id").cast("string").alias("id"), "label", "x").mapInArrow(run, PART)


def relabelled_sums(rows: DataFrame, n: int, total: int, count: int, seed: str) -> DataFrame:
    """rows (id, label string, x array<double>) -> replicate, label, at, value: sums of x over the first n of total rows.

    A pass suffices but for once in some 10^14 relabellings, when the n-th key lies outside of the strip; then the strip is widened.
    """
    share, width = n / max(total, 1), DEVIATIONS
    while True:
        strip = width * (math.sqrt(max(share * (1 - share), 0.0) / max(total, 1)) + 1 / max(total, 1))
        low, high = share - strip, share + strip
        dealt = rows.select("id", "label", F.array_append("x", F.lit(1.0)).alias("x")).repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")
        parts = written(_parts(dealt, low, high, count, seed), "relabelled")
        spread = parts.where("NOT ranked").select("replicate", "label", F.posexplode("x").alias("at", "value"))
        sums = spread.groupBy("replicate", "label", "at").agg(F.sum("value").alias("value"))
        size = parts.where("NOT ranked").groupBy("replicate").agg(F.sum(F.element_at("x", -1)).cast("long").alias("before"))
        every = rows.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("replicate"))
        wanted = every.join(size, "replicate", "left").select("replicate", (F.lit(n) - F.coalesce("before", F.lit(0))).alias("left"))  # a row for each replicate
        strips = parts.where("ranked").groupBy("replicate").agg(F.count("*").alias("k"))
        lost = wanted.join(strips, "replicate", "left").where("left < 0 OR left > coalesce(k, 0)")
        if lost.isEmpty():
            break
        width *= 4
    place = F.row_number().over(Window.partitionBy("replicate").orderBy("key", "id"))  # the rows of a strip
    ranked = parts.where("ranked").withColumn("place", place).join(F.broadcast(wanted), "replicate").where(F.col("place") <= F.col("left"))
    rest = ranked.select("replicate", "label", F.posexplode("x").alias("at", "value"))
    return sums.unionByName(rest).groupBy("replicate", "label", "at").agg(F.sum("value").alias("value"))


# ---------------------------------------------------------------- draws from counts

#: Fixed value: numbers of which a draw without replacement is worked out by the generator itself.
MOST_DRAWN = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` draws without replacement are good, for numbers of any size.

    Beyond what the generator takes, the distribution function is inverted over twelve standard deviations around the mode, from
    the ratios of neighbouring probabilities.
    """
    if good + bad < MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mode = min(max((take + 1) * (good + 1) // (good + bad + 2), low), high)
    all_ = good + bad
    spread = math.sqrt(take / all_ * good * (bad / all_) * ((all_ - take) / max(all_ - 1, 1)))
    reach = int(12 * spread) + 20
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log((good - k) * (take - k)) - np.log((k + 1) * (bad - take + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    upto = np.cumsum(weight)
    return a + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def _split(rng: np.random.Generator, totals: np.ndarray, take: int) -> np.ndarray:
    whole = int(totals.sum())
    if whole < MOST_DRAWN:
        return rng.multivariate_hypergeometric(totals, take, method="marginals")
    if len(totals) == 1:
        return np.array([take], np.int64)
    half = min(max(int(np.searchsorted(np.cumsum(totals), whole / 2)), 1), len(totals) - 1)
    left = int(totals[:half].sum())
    k = hypergeometric(rng, left, whole - left, take)
    return np.concatenate([_split(rng, totals[:half], k), _split(rng, totals[half:], take - k)])


def drawn_counts(totals: np.ndarray, take: int, *seed: int) -> np.ndarray:
    """How many of `take` rows, drawn without replacement, fall on each of groups of so many rows."""
    return _split(np.random.default_rng(seed), np.asarray(totals, np.int64), take)

"""Approximate nearest neighbours by inner product: inverted lists scanned by adaptive dimension sampling.

Inner product becomes distance by one more coordinate (the root of what a vector's norm lacks of the largest one).  Vectors
are dealt to the lists of k-means centroids; a query probes its nearest lists, as many as gave RECALL on the fitting sample.
There are about as many lists as the root of the number of vectors: beyond COARSE of them a list is a centroid plus one of
several centroids of what vectors differ from their centroid by, so a bounded sample fits any number of lists.
Within a list, rotated coordinates are read in blocks of BLOCK columns: after each block a hypothesis test on the partial
distance drops candidates that are, almost surely, beyond the query's bound; the bound starts from a few seeds of the
fitting sample (which are candidates too), tightens as the list goes by, and is that of the nearest lists for all others.  What is left is scored with the original vectors in double precision.

Lists with many vectors or many queries are cut into chunks, so no task holds more than LIST_ROWS x LIST_QUERIES of them.

Centroids and the number of probes are fitted on a bounded sample; every vector is indexed.  Null ids take no part, nor do
vectors of another dimension than most.  Rows that share a query's id are its own row; equal rows of another id are one
candidate.  Tables of at most 8 * K rows have no seeds: their bound starts open, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stash
from plumbline.llm.vectors import matrix, rotation, sample, usable

K, RECALL, BLOCK, EPSILON = 20, 0.97, 16, 2.1
COARSE, LIST_ROWS, LIST_QUERIES = 1024, 4096, 8192
#: Distances to lists that a task holds at a time.
HELD = 1 << 22
#: Sampled vectors that give a query its first bound: an eighth of all, at most so many.
SEEDS = 2048
#: One of so many probed lists, the nearest ones, is scanned ahead of the others.
FIRST = 8


@dataclass
class Index:
    top: float
    centroids: np.ndarray
    turn: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    probes: int
    inner: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.inner is None:
            self.inner = np.zeros((1, self.centroids.shape[1]))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def far(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Distances (up to a number for each row) of blocks of rows to all lists; list c * len(inner) + r is centroid c plus inner centroid r."""
        lists = len(self.centroids) * len(self.inner)
        size = (self.centroids**2).sum(axis=1)[:, None] + (self.inner**2).sum(axis=1)[None] + 2 * self.centroids @ self.inner.T
        step = max(1, HELD // lists)
        for low in range(0, len(x), step):
            some = x[low : low + step]
            yield (size[None] - 2 * ((some @ self.centroids.T)[:, :, None] + (some @ self.inner.T)[:, None, :])).reshape(len(some), lists)

    def nearest_lists(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists of each row, nearest first."""
        if k == 1:
            out = [far.argmin(axis=1)[:, None] for far in self.far(x)]
        else:
            out = [np.argsort(far, axis=1, kind="stable")[:, :k] for far in self.far(x)]
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)

    def seeds(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Squared distance within which k seeds lie (infinite if there are fewer), and those seeds: query, seed, score."""
        inside = exact_scores(q, self.vectors)
        own = q_ids[:, None] == self.ids[None]
        inside[own] = -np.inf
        best = np.argsort(-inside, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(inside, best, axis=1)
        bound = np.full(len(q), np.inf)
        if best.shape[1] == k:
            bound = (q**2).sum(axis=1) + self.top - 2 * score[:, -1]
        at = np.repeat(np.arange(len(q)), best.shape[1])
        real = np.isfinite(score.ravel())
        return np.maximum(bound, 0) * (1 + 1e-9) + 1e-12, at[real], best.ravel()[real], score.ravel()[real]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, summed in one order for every pair, so that copies tie exactly."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j : j + 1] * x[:, j][None]
    return out


def k_means(x: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """So many centroids of the rows; one that gets no rows stays where it was."""
    centroids = x[np.random.default_rng(5).choice(len(x), count, replace=False)]
    for _ in range(rounds):
        size = (centroids**2).sum(axis=1)[None]
        near = np.concatenate([(size - 2 * x[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        filled, start = np.unique(near[order], return_index=True)
        centroids = centroids.copy()
        centroids[filled] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(order)))[:, None]
    return centroids


def fit(rows: DataFrame, n: int, k: int = K) -> Index:
    top = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    ids, x = sample(rows)
    index = Index(top, np.zeros((1, x.shape[1] + 1)), rotation(x.shape[1] + 1, 3), ids, x, 1)
    if not len(x):
        return index
    lifted = index.lift(x, False)
    wanted = max(1, round(np.sqrt(n)))
    coarse = int(np.clip(wanted, 1, min(COARSE, max(1, len(x) // 8))))
    index.centroids = k_means(lifted, coarse)
    if wanted > 2 * coarse:
        rest = lifted - index.centroids[index.nearest_lists(lifted, 1)[:, 0]]
        index.inner = k_means(rest, int(min(-(-wanted // coarse), max(1, len(x) // 8))))
    near = index.nearest_lists(lifted, 1)[:, 0]
    # Recall on the sample: at which probe each true neighbour's list comes.
    test = np.arange(min(len(x), 500))
    score = x[test] @ x.T
    score[ids[test][:, None] == ids[None]] = -np.inf
    true = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
    at, low = [], 0
    for far in index.far(index.lift(x[test], True)):
        hit = np.take_along_axis(far, near[true[low : low + len(far)]], axis=1)
        at += [np.searchsorted(np.sort(row), h) for row, h in zip(far, hit, strict=True)]
        low += len(far)
    at = np.sort(np.concatenate(at))
    keep = np.sort(np.argsort(ids, kind="stable")[:: max(8, -(-len(ids) // SEEDS))]) if n > 8 * k else np.arange(0)
    index.ids, index.vectors = ids[keep], x[keep]
    index.probes = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1
    return index


def scan_list(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, x_ids: np.ndarray, index: Index, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query index, vector index, score of up to k candidates of each query in a list; ties to the smaller id."""
    qr, xr = index.lift(q, True) @ index.turn, index.lift(x, False) @ index.turn
    d, found = qr.shape[1], []
    bound = bound.copy()
    for low in range(0, len(x), 1024):
        xb, part = xr[low : low + 1024], np.zeros((len(q), min(1024, len(x) - low)))
        alive = q_ids[:, None] != x_ids[None, low : low + 1024]
        pairs = None
        for at in range(0, d, BLOCK):
            qs, xs = qr[:, at : at + BLOCK], xb[:, at : at + BLOCK]
            if pairs is None:
                part += (qs**2).sum(axis=1)[:, None] + (xs**2).sum(axis=1)[None] - 2 * qs @ xs.T
            else:
                partial = partial + ((qs[pairs[0]] - xs[pairs[1]]) ** 2).sum(axis=1)
            seen = min(at + BLOCK, d)
            limit = bound * ((1 + EPSILON / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1 + 1e-9)
            if pairs is None:
                alive &= part <= limit[:, None] + 1e-9
                if alive.mean() < 0.2:
                    pairs = np.nonzero(alive)
                    partial = part[pairs]
            else:
                keep = partial <= limit[pairs[0]] + 1e-9
                pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
        if pairs is None:
            pairs = np.nonzero(alive)
        qi, xi = pairs[0], pairs[1] + low
        score = np.zeros(len(qi))
        for j in range(q.shape[1]):  # the order of exact_scores()
            score += q[qi, j] * x[xi, j]
        found.append((qi, xi, score))
        qi, xi, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((x_ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.searchsorted(qi, np.arange(len(q)))
        keep = np.arange(len(qi)) - first[qi] < k
        found = [(qi[keep], xi[keep], score[keep])]
        qi, xi, score = found[0]
        count = np.bincount(qi, minlength=len(q))
        full = np.flatnonzero(count >= k)
        last = np.searchsorted(qi, full) + k - 1
        worst = ((q[full] ** 2).sum(axis=1) + index.top - 2 * score[last]) * (1 + 1e-9) + 1e-12
        bound[full] = np.minimum(bound[full], worst)
    return found[0]


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (vec_id, embedding) among rows."""
    rows, queries = (usable(d.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")) for d in (rows, queries))
    n = rows.count()
    index = fit(rows, n, k)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # bounded by FIT_ROWS and COARSE

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.nearest_lists(shared.value.lift(matrix(batch.column(1)), False), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["list", "vec_id", "embedding"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value, ["list", "turn", "query_id", "vector", "bound", "vec_id", "score"]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                x, own = matrix(some.column(1)), some.column(0).to_numpy()
                lists = index.nearest_lists(index.lift(x, True), index.probes)
                bound, of, seed, score = index.seeds(x, own, k)
                at = np.repeat(np.arange(len(x)), lists.shape[1])
                none = pa.nulls(len(at), pa.int64())
                turn = np.tile(np.arange(lists.shape[1], dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), pa.array(turn), some.column(0).take(pa.array(at)), some.column(1).take(pa.array(at)), pa.array(bound[at]), none, none.cast(pa.float64())], names)
                none = [pa.nulls(len(of), t) for t in (pa.int32(), pa.int32(), some.column(1).type, pa.float64())]
                yield pa.RecordBatch.from_arrays([*none[:2], pa.array(own[of]), *none[2:], pa.array(index.ids[seed]), pa.array(score)], names)

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = stash(rows.mapInArrow(deal, f"list int, vec_id long, embedding {kind}"), "ann-lists")
    asked = stash(queries.mapInArrow(probe, f"list int, turn int, query_id long, vector {kind}, bound double, vec_id long, score double"), "ann-probes")
    seeds, asked = asked.where("list is null").select("query_id", "vec_id", "score"), asked.where("list is not null").drop("vec_id", "score")
    # Lists with many vectors or queries are cut into chunks; the others (all, often) have no row in these tables.
    cut_rows, cut_asks = (
        stash(d.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1), f"ann-{name}") for d, most, name in ((dealt, LIST_ROWS, "row_chunks"), (asked, LIST_QUERIES, "ask_chunks"))
    )

    def with_chunks(some: DataFrame) -> DataFrame:
        some = some.join(cut_rows, "list", "left").join(cut_asks, "list", "left")
        return some.withColumn("row_chunks", F.coalesce("row_chunks", F.lit(1))).withColumn("ask_chunks", F.coalesce("ask_chunks", F.lit(1)))

    left = with_chunks(dealt).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("row_chunks")).cast("int")).withColumn("q_chunk", F.explode(F.expr("sequence(0, ask_chunks - 1)"))).drop("row_chunks", "ask_chunks")

    def answer(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if x.num_rows and q.num_rows:
            own, vectors = (np.concatenate([f(c) for c in x[name].chunks]) for name, f in (("vec_id", lambda c: c.to_numpy()), ("embedding", matrix)))
            ids, asks, bound = (np.concatenate([f(c) for c in q[name].chunks]) for name, f in (("query_id", lambda c: c.to_numpy()), ("vector", matrix), ("bound", lambda c: c.to_numpy())))
            order = np.argsort(own, kind="stable")
            own, vectors, parts = own[order], vectors[order], []
            for low in range(0, len(ids), 512):
                qi, xi, score = scan_list(asks[low : low + 512], ids[low : low + 512], bound[low : low + 512], vectors, own, shared.value, k)
                parts.append((ids[low + qi], own[xi], score))
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    def scan(some: DataFrame) -> DataFrame:
        right = with_chunks(some).withColumn("q_chunk", F.pmod(F.xxhash64("query_id"), F.col("ask_chunks")).cast("int")).withColumn("chunk", F.explode(F.expr("sequence(0, row_chunks - 1)"))).drop("row_chunks", "ask_chunks")
        cells = ["list", "chunk", "q_chunk"]
        return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(answer, "query_id long, vec_id long, score double")

    def best(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.distinct().withColumn("rank", rank).where(F.col("rank") <= k)

    # The nearest lists come first; what they give bounds the scan of the others.
    first = max(1, index.probes // FIRST)
    found = stash(best(scan(asked.where(F.col("turn") < first)).union(seeds)).select("query_id", "vec_id", "score"), "ann-found")
    if index.probes > first:
        kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "kth")
        size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        limit = F.greatest(F.lit(0.0), size + index.top - 2 * F.col("kth")) * (1 + 1e-9) + 1e-12
        rest = asked.where(F.col("turn") >= first).join(kth, "query_id", "left").withColumn("bound", F.least("bound", limit)).drop("kth")
        found = scan(rest).union(found)
    return best(found).select("query_id", "rank", "vec_id", "score")

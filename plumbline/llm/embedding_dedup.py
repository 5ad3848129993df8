"""Embedding near-dedup: codes by iterative quantisation, multi-index Hamming tables, reranking with original vectors.

Rotations are learned that bring the vectors of a bounded sample close to the corners of a cube, so that the signs of the
rotated coordinates are balanced bits.  The code is cut into tables of a few bits each: two vectors of a label whose codes
differ in fewer bits than there are tables agree in all bits of some table and meet there; most pairs that differ in more bits do too.
The number of tables is measured, not assumed: for vectors of the sample that nothing was learned on, partners at exactly the threshold are made up, and tables are
added until the share MEET of these pairs meets, with and without centring and for several sizes of tables; the plan that
compares fewest vectors is taken.  Every pair that meets is decided by the cosine of the original vectors in double
precision, in the first table where it meets and nowhere else.

Equal vectors of a label are one vector with a multiplicity.  A table cell with many vectors is cut into blocks, and pairs
of blocks are cells of their own, so no task holds more than two blocks.  The number of links of each vector is asked for, so
a group of m different vectors that are all near each other costs m * m comparisons, in blocks.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite numbers, and rows with a null label
link with nothing: they are components of their own.  Rows that share an id are vectors of their own, each with its own
links; a component is named by the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stash
from plumbline.llm.components import connected_components
from plumbline.llm.vectors import matrix, rotation, sample, usable

COSINE, MEET, CELL_ROWS = 0.93, 0.97, 1024
#: Sampled vectors that rotations are learned on, and pairs that the plan is measured on.
LEARN_ROWS, PLAN_PAIRS = 2048, 2000
#: Parts that the lookup of a component's name is cut into.
SALTS = 16


def learn_rotations(v: np.ndarray, bits: int, rounds: int = 12) -> np.ndarray:
    """So many columns of rotations side by side: each alternates between the nearest corners and the best turn to them."""
    d, out = v.shape[1], []
    basis = np.linalg.svd(v.T @ v)[0] if len(v) else np.eye(d)
    for k in range(-(-bits // d)):
        turn = rotation(d, 100 + k)
        z = v @ basis
        for _ in range((rounds if d <= 128 else rounds // 3) if len(v) else 0):
            u, _, w = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ w).T
        out.append(basis @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def table_codes(v: np.ndarray, turn: np.ndarray, bits: int) -> np.ndarray:
    """Codes of rows in each table."""
    weight = 1 << np.arange(bits, dtype=np.int64)
    tables = turn.shape[1] // bits
    return ((v @ turn[:, : tables * bits] >= 0).reshape(len(v), tables, bits) * weight).sum(axis=2)


def plan_tables(x: np.ndarray, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """mean, rotations, bits of a table and number of tables, from unit vectors of a sample and the largest label's rows."""
    d = x.shape[1]
    full = int(np.clip(np.ceil(np.log2(max(most, 2))) - 3, 6, 30))
    if len(x) < 2:
        return np.zeros(d), learn_rotations(np.zeros((0, d)), full * 2), full, 2
    rng = np.random.default_rng(9)
    learn, x = (x[: len(x) // 2], x[len(x) // 2 :]) if len(x) >= 64 else (x, x)  # measured on rows that it was not learned on
    learn = learn[:LEARN_ROWS]
    one = x[rng.integers(0, len(x), PLAN_PAIRS)]
    other = rng.standard_normal(one.shape)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other = threshold * one + np.sqrt(1 - threshold**2) * other / np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    left, right = x[rng.integers(0, len(x), 2 * PLAN_PAIRS)], x[rng.integers(0, len(x), 2 * PLAN_PAIRS)]
    sizes = sorted({full, max(4, full - 2), max(4, full - 4), max(4, full - 6)}, reverse=True)
    agree = 1 - np.arccos(threshold) / np.pi
    wide = int(max(1.3 * b * np.log(1 - MEET) / np.log(1 - agree**b) for b in sizes)) + 2 * full
    while True:
        plans = []
        for mean in (learn.mean(axis=0), np.zeros(d)):
            turn = learn_rotations(learn - mean, wide)
            signs = [(v - mean) @ turn >= 0 for v in (one, other, left, right)]
            for bits in sizes:
                some = wide // bits
                x_, y_, l_, r_ = (s[:, : some * bits].reshape(len(s), some, bits) for s in signs)
                met = np.logical_or.accumulate((x_ == y_).all(axis=2), axis=1).mean(axis=0)
                if met[-1] >= MEET:
                    tables = max(2, int(np.argmax(met >= MEET)) + 1)
                    chance = (l_[:, :tables] == r_[:, :tables]).all(axis=2).mean()
                    plans.append((tables * (1 + most * chance / 64), tables, mean, turn[:, : tables * bits], bits))
        if plans:
            _, tables, mean, turned, bits = min(plans, key=lambda p: p[:2])
            return mean, turned, bits, tables
        wide = wide * 3 // 2


def near_components(rows: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    spark = rows.sparkSession
    good = usable(rows.where("vec_id is not null and label is not null"))
    key = ["label", "h1", "h2"]
    slim = stash(good.select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")), "vector-keys")
    heads = slim.groupBy(*key).agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
    # Nodes are numbered in the order of their smallest ids, so a component's smallest node has its smallest id.
    heads = stash(heads.orderBy("head", "h1", "h2").withColumn("node", F.monotonically_increasing_id()), "vector-heads")
    most = heads.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    _, x = sample(good)
    mean, turn, bits, tables = plan_tables(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), most, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2))
            if len(v):
                codes = table_codes(v / np.linalg.norm(v, axis=1, keepdims=True) - mean, turn, bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "label", "embedding", "copies", "codes"])

    kind, label = good.schema["embedding"].dataType.simpleString(), good.schema["label"].dataType.simpleString()
    keyed = good.select("label", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), "embedding").dropDuplicates(key)
    whole = keyed.join(heads, key).select("node", "label", "embedding", "copies")
    coded = stash(whole.mapInArrow(code, f"node long, label {label}, embedding {kind}, copies long, codes array<long>"), "vector-codes")
    spots = coded.select("node", "label", F.posexplode("codes").alias("table", "code"))
    sizes = stash(spots.groupBy("label", "table", "code").agg(F.count("*").alias("n")).where("n > 1"), "vector-cells")
    spots = spots.join(sizes, ["label", "table", "code"]).withColumn("blocks", F.ceil(F.col("n") / CELL_ROWS).cast("int"))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = spots.select("node", "table", "block", (F.col("block") == F.col("other")).alias("alone"), F.xxhash64("label", "table", "code", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))
    cells = cells.join(coded, "node").repartition("cell").sortWithinPartitions("cell")

    def pairs_of(c: dict) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of a cell whose first common table is the cell's and whose cosine reaches the threshold."""
        v, codes, table = c["v"], c["codes"], c["table"][0]
        a_all, b_all = [], []
        for low in range(0, len(v), 512):
            a, b = np.nonzero(v[low : low + 512] @ v.T >= threshold)
            a = a + low
            good = (a < b) & (c["label"][a] == c["label"][b]) & (c["alone"][a] | (c["block"][a] != c["block"][b])) & (c["table"][b] == c["table"][a])
            a, b = a[good], b[good]
            same = codes[a, : table + 1] == codes[b, : table + 1]
            good = same[:, table] & ~same[:, :table].any(axis=1)
            a_all.append(a[good])
            b_all.append(b[good])
        return np.concatenate(a_all), np.concatenate(b_all)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, other, links): links add up to n_links; others tie a cell's components together."""
        held = None

        def work(c: dict) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], c["cell"][1:] != c["cell"][:-1]]))
            nodes, others, links = [], [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(c["cell"])], strict=True):
                if e - s < 2:
                    continue
                part = {k: x[s:e] for k, x in c.items()}
                a, b = pairs_of(part)
                if not len(a):
                    continue
                count = np.zeros(e - s, np.int64)
                np.add.at(count, a, part["copies"][b])
                np.add.at(count, b, part["copies"][a])
                root = np.arange(e - s)
                while True:  # smallest index that the cell's links reach
                    new = root.copy()
                    np.minimum.at(new, a, root[b])
                    np.minimum.at(new, b, root[a])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                at = np.flatnonzero(count)
                nodes.append(part["node"][at])
                others.append(part["node"][root[at]])
                links.append(count[at])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, others, links)], ["node", "other", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(7))
            c = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(("cell", "node", "table", "block", "alone", "label", "copies"))}
            c |= {"v": v / np.linalg.norm(v, axis=1, keepdims=True), "codes": batch.column(8).flatten().to_numpy().reshape(-1, tables)}
            if held:
                c = {k: np.concatenate([held[k], x]) for k, x in c.items()}
            cut = int(np.flatnonzero(c["cell"] == c["cell"][-1])[0])  # the last cell may go on
            held = {k: x[cut:] for k, x in c.items()}
            yield from work({k: x[:cut] for k, x in c.items()})
        if held:
            yield from work(held)

    found = stash(cells.select("cell", "node", "table", "block", "alone", "label", "copies", "embedding", "codes").mapInArrow(meet, "node long, other long, links long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = stash(connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))), "vector-components")
    # A component may hold most nodes: its name is looked up by salts.
    names = parts.select("component").distinct().join(heads.select(F.col("node").alias("component"), F.col("head").alias("least")), "component")
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(names, ["component", "salt"]).select("node", "least")
    named = heads.join(links, "node", "left").join(parts, "node", "left")
    named = stash(named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "head").alias("component")), "vector-answer")
    out = rows.select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")).withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    out = out.join(named, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

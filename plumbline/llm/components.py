"""Connected components of an edge table: forests of bounded blocks of edges, then rounds of star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stash

#: Edges that one task replaces by the stars of their own components.
BLOCK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node, smallest node that these edges reach, for every node but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def mark(edges: DataFrame) -> tuple:
    """Count and checksums of an edge table: two rounds are alike if these are."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def contract(edges: DataFrame, blocks: int) -> DataFrame:
    """The edges in so many blocks, each replaced by the stars of its own components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) > 2 * BLOCK_EDGES:
                held = list(forest(*held))
                if len(held[0]) > BLOCK_EDGES:  # a forest that stays large goes on in the rounds
                    yield out()
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if len(held[0]):
            held = list(forest(*held))
            yield out()

    return edges.repartition(blocks).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, component (smallest node that links reach), for every node that has an edge.

    If one block holds all edges, its forest is the answer.  Otherwise large-star and small-star steps alternate: every step
    links a node to the smallest neighbour it knows, so distances shrink by half and a hub's neighbours are spread over
    their own keys.  Ends when a round changes nothing, however many it takes.
    """
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    blocks = -(-now.count() // BLOCK_EDGES)
    now = stash(contract(now, max(1, blocks)).select("a", "b"), "edges")
    if blocks > 1:
        last = mark(now)
        while True:
            # Large star: each node's larger neighbours are linked to the smallest of it and its neighbours.
            both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a != b").distinct()
            # Small star: each node and its smaller neighbours are linked to the smallest of them.
            small_least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
            now = stash(small.where("a != b").distinct(), "edges")
            seen = mark(now)
            if seen == last:
                break
            last = seen
    tips = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().join(tips, "node", "left_anti").select("node", F.col("node").alias("component"))
    return tips.union(roots)

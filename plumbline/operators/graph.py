"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import written


def mark(edges: DataFrame) -> tuple:
    """Count and checksums of an edge table: two rounds are alike if these are."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (smallest reachable node), by alternating large-star and small-star rounds.

    Rounds go on until one changes nothing.  Every round is written to the shared folder; a hub's neighbours are spread over their own keys.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", "m")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        new = written(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a != b").distinct(), "edges")
        seen = mark(new)
        now = new
        if seen == last:
            break
        last = seen
    tips = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return tips.union(now.select(F.col("b").alias("node")).distinct().join(tips, "node", "left_anti").select("node", "node"))

"""Running totals, positions and quantiles over whole tables without a window that holds one.

Rows are dealt by ranges of their order; totals of the ranges (a row for each partition) are summed in one small window, and
each range is ranked for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written


def running_total(rows: DataFrame, by: str, value: str | None = None, within: str | None = None, descending: bool = False, out: str = "upto") -> DataFrame:
    """rows with the sum of value (or the number of rows) up to and with each row, in order of `by`, for each `within`.

    The order should be total: rows with an equal `by` are counted in any order.
    """
    amount = F.col(value) if value else F.lit(1)
    order = [F.col(by).desc() if descending else F.col(by).asc()]
    keys = [F.col(within), *order] if within else order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    same = ["__part", within] if within else ["__part"]
    sums = dealt.groupBy(*same).agg(F.sum(amount).alias("__sum"))
    groups = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))  # a row for each partition
    before = groups.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*same, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    own = Window.partitionBy(*same).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(ahead, same).withColumn(out, F.sum(amount).over(own) + F.col("__ahead")).drop("__part", "__ahead")


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], out: str = "q") -> DataFrame:
    """group, out: the exact interpolated quantiles of value for each group, from counts of its distinct values."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("__k"))
    ranked = running_total(counts, value, "__k", within=group, out="__upto")
    sizes = counts.groupBy(group).agg(F.sum("__k").alias("__n"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("__n") - 1) * F.lit(s)).alias("at")) for i, s in enumerate(shares)))

    def inside(place):
        return (place >= F.col("__upto") - F.col("__k")) & (place < F.col("__upto"))

    near = ranked.join(sizes, group).withColumn("w", F.explode(F.filter(wanted, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))))
    low, high = (F.max(F.when(inside(f(F.col("w.at"))), F.col(value))) for f in (F.floor, F.ceil))
    ends = near.groupBy(group, "w.i", "w.at").agg(low.alias("low"), high.alias("high"))
    at = F.col("at")
    between = F.when(F.floor(at) == F.ceil(at), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    return ends.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda s: s["v"]).alias(out))  # a few numbers for each group

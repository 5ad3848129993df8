"""Seeded mutations of a sample table with their ground truth, for evaluation: the truth is never part of what is analysed.

samples: sample_id, content, label, contributor.  A scenario returns (samples, truth); truth: sample_id, attack_class, role.
Which rows change is an order by a hash of seed and id, so any engine picks the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string")).cast("binary"), 256)


def pick(samples: DataFrame, count: int, seed: int) -> DataFrame:
    """The first rows by hash of seed and id: a fixture's bounded choice."""
    return samples.orderBy(_order(seed), "sample_id").limit(count)


def _truth(rows: DataFrame, attack_class: str, role: str) -> DataFrame:
    return rows.select("sample_id", F.lit(attack_class).alias("attack_class"), F.lit(role).alias("role"))


def duplicate_flood(samples: DataFrame, contributor: str, sources: int, copies: int, seed: int = 101) -> tuple[DataFrame, DataFrame]:
    """A contributor adds exact copies of some of its samples."""
    chosen = pick(samples.where(F.col("contributor") == contributor), sources, seed)
    added = chosen.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("sample_id", F.concat_ws("~", F.col("sample_id").cast("string"), "k")).drop("k")
    out = samples.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(added)
    return out, _truth(added, "duplicate_flood", "copy").unionByName(_truth(chosen.withColumn("sample_id", F.col("sample_id").cast("string")), "duplicate_flood", "source"))


def near_duplicate_flood(samples: DataFrame, contributor: str, sources: int, copies: int, seed: int = 202) -> tuple[DataFrame, DataFrame]:
    """Copies that differ in a mark at their end."""
    out, truth = duplicate_flood(samples, contributor, sources, copies, seed)
    marked = F.when(F.col("sample_id").contains("~"), F.concat("content", F.lit(" "), F.substring_index("sample_id", "~", -1))).otherwise(F.col("content"))
    return out.withColumn("content", marked), truth.withColumn("attack_class", F.lit("near_duplicate_flood"))


def label_flip(samples: DataFrame, count: int, labels: list[str], seed: int = 303) -> tuple[DataFrame, DataFrame]:
    """Some labels become the next one of the list."""
    chosen = pick(samples.where(F.col("label").isin(labels)), count, seed).select("sample_id")
    following = F.create_map(*(F.lit(x) for a, b in zip(labels, labels[1:] + labels[:1], strict=True) for x in (a, b)))
    marked = samples.join(F.broadcast(chosen.withColumn("flip", F.lit(True))), "sample_id", "left")  # count rows
    return marked.withColumn("label", F.when(F.col("flip"), F.element_at(following, F.col("label"))).otherwise(F.col("label"))).drop("flip"), _truth(chosen, "label_flip", "flipped")


def systematic_mislabel(samples: DataFrame, contributor: str, source: str, target: str, share: float, seed: int = 404) -> tuple[DataFrame, DataFrame]:
    """A contributor labels a share of one class as another."""
    turn = F.conv(F.substring(_order(seed), 1, 6), 16, 10).cast("double") / 0x1000000 < share
    hit = (F.col("contributor") == contributor) & (F.col("label") == source) & turn
    return samples.withColumn("label", F.when(hit, target).otherwise(F.col("label"))), _truth(samples.where(hit), "systematic_mislabel", "mislabelled")


def foreign_insertion(samples: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of another origin are added."""
    return samples.unionByName(foreign), _truth(foreign, "ood_insertion", "foreign")


# Logs: log_id, line, sequence, digest, previous.


def deleted(log: DataFrame, line: int) -> DataFrame:
    return log.where(F.col("line") != line)


def reordered(log: DataFrame, a: int, b: int) -> DataFrame:
    return log.withColumn("line", F.when(F.col("line") == a, b).when(F.col("line") == b, a).otherwise(F.col("line")))


def edited(log: DataFrame, line: int) -> DataFrame:
    return log.withColumn("digest", F.when(F.col("line") == line, F.sha2(F.concat("digest", F.lit("edited")).cast("binary"), 256)).otherwise(F.col("digest")))


def repeated(log: DataFrame, line: int) -> DataFrame:
    last = log.agg(F.max("line")).first()[0]
    return log.unionByName(log.where(F.col("line") == line).withColumn("line", F.lit(last + 1).cast(log.schema["line"].dataType)))


def truncated(log: DataFrame, keep: int) -> DataFrame:
    return log.where(F.col("sequence") < keep)


def front_truncated(log: DataFrame, drop: int) -> DataFrame:
    return log.where(F.col("sequence") >= drop)

"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its share of the budget by weight, at most MOST_COPIES times its size; what exceeds that goes to the
others by weight until none is above (water filling, solved on the table of sources).  Every document of a source expects
target / size copies; the running sum of expected copies, plus one offset of the source, gives a copy for each integer
that it crosses.  Documents run in order of size class, so the words that are taken stay close to the target.

The running sum has three levels: size classes of a source, cells of a class, documents of a cell.  Documents of a class are
ordered by the hash of their id (of their text, where the id is null), those of one id by the hash of their text; a cell
is a prefix of that hash, which is longer the more rows there are, and does not change the order.  So a source with a third
of all rows is ranked in thousands of tasks' worth of cells, whatever its ids, and no window holds more than one cell.

A null text has size 0; a null source is a source of its own, last in order; null ids and repeated rows are ranked like
others.  Rows that tie have equal ids and texts, hence equal sizes; mix() orders them by their other columns.  The
offset is a hash of seed and source, so reruns agree, in whatever order the rows come.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stash

WEIGHTS = (3, 1, 2)
BUDGET, MOST_COPIES = 1.5, 2
#: Rows of the whole table for which one hexadecimal digit less of the hash would do; cells have two digits at least.
ROWS_A_CELL_DIGIT = 10**8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(column: str | F.Column) -> F.Column:
    return F.md5((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def cell_digits(rows: int) -> int:
    """Digits of the hash that name a cell of a table of so many rows."""
    return max(2, math.ceil(math.log(max(rows, 1) / ROWS_A_CELL_DIGIT, 16)))


def with_cells(docs: DataFrame, size: F.Column, text_digest: F.Column, digits: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with __mix_size, their order in a size class (__mix_hash, __mix_text) and the cell of each row: source, size class
    (power of two and three more bits), prefix of the hash."""
    length = F.length(F.bin(F.col("__mix_size")))
    steps = F.expr("shiftright(__mix_size, cast(greatest(length(bin(__mix_size)) - 4, 0) as int)) & 7")
    return (
        docs.withColumn("__mix_size", size)
        .withColumn("__mix_source", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")))
        .withColumn("__mix_class", (length * 8 + steps).cast("int"))
        .withColumn("__mix_text", F.coalesce(text_digest, F.lit("")))
        .withColumn("__mix_hash", F.coalesce(digest(id_col), F.col("__mix_text")))
        .withColumn("__mix_bucket", F.substring("__mix_hash", 1, digits))
    )


CELL = ["__mix_source", "__mix_class", "__mix_bucket"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """__mix_source, size (a row for each source) -> with weight, target, rate (expected copies) and offset."""
    one = Window.partitionBy(F.lit(0))  # a row for each source
    by_name = one.orderBy((F.col("__mix_source") == "null").cast("int"), "__mix_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("size") * MOST_COPIES)
    by_level = one.orderBy(F.col("cap") / F.col("weight"), "__mix_source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", F.sum("size").over(one) * F.lit(budget))
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("weights") <= F.col("weight") * F.col("left"))
    open_left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(one), F.lit(0))
    level = F.try_divide(open_left, F.sum(F.when(~F.col("full"), F.col("weight"))).over(one))
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("__mix_source")).cast("binary")), 1, 5), 16, 10).cast("double") / (1 << 20)
    return rows.select("__mix_source", "size", "target", F.coalesce(F.try_divide("target", "size"), F.lit(0.0)).alias("rate"), offset.alias("offset"))


def cell_offsets(cells: DataFrame) -> DataFrame:
    """Counts by cell (__mix_n documents, __mix_words) -> the number of documents of the source before each cell, with the
    source's size, target, rate and offset."""
    classes = cells.groupBy("__mix_source", "__mix_class").agg(F.sum("__mix_n").alias("n"), F.sum("__mix_words").alias("words"))
    sources = source_targets(classes.groupBy("__mix_source").agg(F.sum("words").alias("size")))
    in_source = Window.partitionBy("__mix_source").orderBy("__mix_class").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("__mix_source", "__mix_class").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("ahead", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n", "words").join(sources, "__mix_source")
    return (
        cells.withColumn("within", F.coalesce(F.sum("__mix_n").over(in_class), F.lit(0)))
        .join(classes, ["__mix_source", "__mix_class"])
        .select(*CELL, (F.col("ahead") + F.col("within")).alias("__mix_ahead"), *(F.col(c).alias(f"__mix_{c}") for c in ("target", "rate", "offset")), F.col("size").alias("__mix_source_size"))
    )


def allot(rows: DataFrame, cells: DataFrame, *ties: F.Column) -> DataFrame:
    """rows (with_cells) with __mix_copies: the integers that the running sum of expected copies crosses in each row."""
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy("__mix_hash", "__mix_text", *ties)) + F.col("__mix_ahead")

    def reached(k: F.Column) -> F.Column:
        return F.floor(F.col("__mix_rate") * k + F.col("__mix_offset"))

    joined = rows.join(cells, CELL).withColumn("__mix_place", place)
    return joined.withColumn("__mix_copies", F.least(F.lit(MOST_COPIES), reached(F.col("__mix_place")) - reached(F.col("__mix_place") - 1)))


def counted(rows: DataFrame) -> DataFrame:
    """Counts by cell, in the shared folder: a few numbers for each cell."""
    return stash(rows.groupBy(*CELL).agg(F.count("*").alias("__mix_n"), F.sum("__mix_size").alias("__mix_words")), "mix-cells")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stash(docs.select("doc_id", "source", word_count("text").alias("size"), F.unhex(digest("text")).alias("text_md5")), "mix-sizes")
    rows = with_cells(sized, F.col("size"), F.lower(F.hex("text_md5")), cell_digits(sized.count()))
    out = allot(rows, cell_offsets(counted(rows)))
    return out.select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, repeated as often as it takes them, with their columns as they are."""
    digits = cell_digits(docs.count())
    cells = cell_offsets(counted(with_cells(docs.select("doc_id", "source", "text"), word_count("text"), digest("text"), digits)))
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    ties = [F.to_json(F.struct(*others))] if others else []
    taken = allot(with_cells(docs, word_count("text"), digest("text"), digits), cells, *ties).where("__mix_copies > 0")
    return taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)


REPORT_SQL = """
    WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS s, coalesce(md5(text), '') AS m, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
    t AS (SELECT s, sum(size) AS size FROM d GROUP BY s),
    w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY (s = 'null')::INT, s) - 1) % 3 + 1] AS weight, size * 2 AS cap FROM t),
    l AS (SELECT *, sum(size) OVER () * 1.5::DOUBLE AS total,
                 sum(size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
                 sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
    f AS (SELECT *, cap * weights <= weight * left_over AS full_up FROM l),
    g AS (SELECT s, size, CASE WHEN full_up THEN cap::DOUBLE
                 ELSE (total - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) / sum(weight) FILTER (NOT full_up) OVER () * weight END AS target,
                 ('0x' || substr(md5('mix' || s), 1, 5))::BIGINT::DOUBLE / 1048576 AS u FROM f),
    r AS (SELECT d.*, g.size AS source_size, g.target, CASE WHEN g.size > 0 THEN g.target / g.size ELSE 0 END AS rate, u,
                 row_number() OVER (PARTITION BY d.s ORDER BY length(bin(d.size)) * 8 + ((d.size >> greatest(length(bin(d.size)) - 4, 0)) & 7), coalesce(md5(doc_id::VARCHAR), m), m) AS k
          FROM d JOIN g ON d.s = g.s)
    SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
           (least(2, floor(rate * k + u) - floor(rate * (k - 1) + u)) * size)::BIGINT AS taken FROM r
"""

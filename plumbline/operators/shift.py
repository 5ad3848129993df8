"""Distribution shift between a reference and a current population.

Statistics are aggregations; null distributions come from permutations that are an order by a hash of (seed, replicate,
id), so any engine draws the same ones.  A test without enough rows says so instead of giving an answer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.statistics import js_bits
from plumbline.operators.neighbours import moments
from plumbline.operators.ranks import quantiles, running_total
from plumbline.operators.relabelling import drawn_counts, relabelled_sums
from plumbline.sources.shared import written

ALPHA, PERMUTATIONS, LEAST_PERMUTATIONS, LEAST_ROWS, MOST_ROWS, MOVED = 0.01, 999, 99, 20, 400, 0.15


def permutation_budget(columns: int, alpha: float = ALPHA, most: int = 4999, base: int = PERMUTATIONS) -> int:
    """Permutations that a corrected test of so many columns needs to be able to reject."""
    return min(most, max(base, -(-columns * round(1 / alpha) // 1) - 1))


def psi(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows (column, side, value) -> column, psi, bins, n_reference, n_current.

    Edges are the reference's interpolated quantiles without repeats, open at both ends; shares have a floor of half a row.
    """
    sides = rows.where("value is not null and not isnan(value)")
    cut = quantiles(sides.where("side = 'reference'").select("column", F.col("value").cast("double").alias("value")), "column", "value", [i / bins for i in range(bins + 1)])
    edges = cut.select("column", F.array_distinct("q").alias("edges")).where(F.size("edges") >= 3)
    inner = F.slice("edges", 2, F.size("edges") - 2)
    binned = sides.join(F.broadcast(edges), "column").withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))).withColumn("bins", F.size("edges") - 1)
    counts = binned.groupBy("column", "bins", "bin").agg(F.count_if(F.expr("side = 'reference'")).alias("r"), F.count_if(F.expr("side = 'current'")).alias("c"))
    every = edges.select("column", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"), (F.size("edges") - 1).alias("bins"))
    full = every.join(counts.drop("bins"), ["column", "bin"], "left").fillna(0, ["r", "c"])
    total = Window.partitionBy("column")
    full = full.withColumn("nr", F.sum("r").over(total)).withColumn("nc", F.sum("c").over(total)).where("nr > 0 and nc > 0")
    p, q = (F.greatest(F.col(k) / F.col(n), 1 / (2 * F.col(n))) for k, n in (("r", "nr"), ("c", "nc")))
    return full.groupBy("column", "bins", F.col("nr").alias("n_reference"), F.col("nc").alias("n_current")).agg(F.round(F.sum((q - p) * F.log(q / p)), 9).alias("psi"))


def psi_band(value: Column) -> Column:
    return F.when(value < 0.1, "stable").when(value < 0.25, "moderate").otherwise("major")


#: Pooled rows that a task of the permutation test draws for at a time, about.
DRAWN_ROWS = 50_000


def psi_permutation_test(rows: DataFrame, bins: int = 10, count: int = 199, seed: int = 20260917) -> DataFrame:
    """rows (column, id, side, value) -> column, psi, as_large, p, q, significant.

    A random relabelling of the pooled rows is a draw of the reference's number of rows without replacement, so a replicate
    is drawn from counts: first, once, how many fall on each block of neighbouring values, then in the block's task how many
    on each value of a block.  Nothing is sorted or copied for a replicate; each has its own edges.  Columns are corrected as
    one family.  A column of fewer than LEAST_ROWS on a side is left out; there is no upper bound.
    """
    import pyarrow as pa

    from plumbline.functions.statistics import benjamini_hochberg

    rows = rows.where("value is not null and not isnan(value)").select("column", "side", F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy("column").agg(F.count_if(F.expr("side = 'reference'")).alias("n"), F.count("*").alias("all"))
    sizes = {r.column: (r.n, r["all"]) for r in sizes.collect() if min(r.n, r["all"] - r.n) >= LEAST_ROWS}  # a row for each column
    rows = rows.where(F.col("column").isin(list(sizes)))
    observed = psi(rows, bins).select("column", F.col("psi").alias("observed"))
    values = running_total(rows.groupBy("column", "value").agg(F.count("*").alias("k")), "value", "k", within="column")
    values = written(values.withColumn("block", F.floor((F.col("upto") - F.col("k")) / DRAWN_ROWS).cast("int")).select("column", "block", "value", "k"), "blocks")
    totals: dict[str, dict[int, int]] = {c: {} for c in sizes}
    for r in values.groupBy("column", "block").agg(F.sum("k").alias("k")).collect():  # a row for each DRAWN_ROWS rows
        totals[r.column][r.block] = r.k
    names = {c: i for i, c in enumerate(sorted(sizes))}
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast({c: (names[c], sizes[c][0], sorted(totals[c]), np.array([totals[c][b] for b in sorted(totals[c])])) for c in names})

    def by_block(batches):
        for batch in batches:
            for column, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, take, blocks, sums = shared.value[column]
                whole = drawn_counts(sums, take, seed, name, b)
                before = np.cumsum(whole) - whole
                yield pa.RecordBatch.from_arrays([pa.array([column] * len(blocks), pa.string()), pa.array(blocks, pa.int32()), pa.array([b] * len(blocks), pa.int32()), pa.array(before, pa.int64()), pa.array(whole, pa.int64())], ["column", "block", "replicate", "before", "take"])

    tasks = spark.createDataFrame([(c,) for c in names], "column string").crossJoin(spark.range(count).select(F.col("id").cast("int").alias("replicate"))).repartition(spark.sparkContext.defaultParallelism, "column", "replicate")
    shares = written(tasks.mapInArrow(by_block, "column string, block int, replicate int, before long, take long"), "block-shares")  # replicates rows for each DRAWN_ROWS rows

    def draws(table: pa.Table, share: pa.Table):
        """column, values in order, their counts, and for each replicate the drawn rows before the block and on each value."""
        column, block = table["column"][0].as_py(), table["block"][0].as_py()
        order = np.argsort(table["value"].to_numpy(), kind="stable")
        value, k = table["value"].to_numpy()[order], table["k"].to_numpy()[order]

        def each():
            for b, before, take in zip(*(share[c].to_pylist() for c in ("replicate", "before", "take")), strict=True):
                yield b, before, drawn_counts(k, take, seed, names[column], b, block + 1)

        return column, value, k, each()

    def quantile_values(table: pa.Table, share: pa.Table) -> pa.Table:
        column, value, _, each = draws(table, share)
        at = np.arange(bins + 1) / bins * (sizes[column][0] - 1)
        wanted = np.stack([np.floor(at), np.ceil(at)]).astype(np.int64)
        out: list[list] = [[], [], []]
        for b, before, drawn in each:
            upto = before + np.cumsum(drawn)
            inside = (wanted >= before) & (wanted < (upto[-1] if len(upto) else before))
            out[0] += [b] * int(inside.sum())
            out[1] += np.flatnonzero(inside.ravel()).tolist()
            out[2] += value[np.searchsorted(upto, wanted[inside], side="right")].tolist()
        return pa.table({"column": pa.array([column] * len(out[0]), pa.string()), "replicate": pa.array(out[0], pa.int32()), "place": pa.array(out[1], pa.int32()), "value": pa.array(out[2], pa.float64())})

    dealt = values.groupBy("column", "block").cogroup(shares.groupBy("column", "block"))
    found = dealt.applyInArrow(quantile_values, "column string, replicate int, place int, value double")
    ends = {c: np.zeros((count, 2, bins + 1)) for c in names}
    for r in found.collect():  # a few numbers for each replicate
        ends[r.column][r.replicate, r.place // (bins + 1), r.place % (bins + 1)] = r.value
    inner = {}
    for c, (low, high) in ((c, (e[:, 0], e[:, 1])) for c, e in ends.items()):
        at = np.arange(bins + 1) / bins * (sizes[c][0] - 1)
        inner[c] = np.where(low == high, low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
    edges = rows.sparkSession.sparkContext.broadcast({c: [np.unique(q) for q in e] for c, e in inner.items()})

    def bin_counts(table: pa.Table, share: pa.Table) -> pa.Table:
        column, value, k, each = draws(table, share)
        out: list[list] = [[], [], [], []]
        for b, _, drawn in each:
            own = edges.value[column][b]
            if len(own) < 3:
                continue
            bin_ = np.searchsorted(own[1:-1], value, side="right")
            for column_, part in ((2, drawn), (3, k - drawn)):
                out[column_] += np.bincount(bin_, weights=part, minlength=len(own) - 1).astype(np.int64).tolist()
            out[0] += [b] * (len(own) - 1)
            out[1] += range(len(own) - 1)
        return pa.table({"column": pa.array([column] * len(out[0]), pa.string()), **{n: pa.array(x, pa.int64()) for n, x in zip(("replicate", "bin", "r", "c"), out, strict=True)}})

    parts = dealt.applyInArrow(bin_counts, "column string, replicate long, bin long, r long, c long")
    total = Window.partitionBy("column", "replicate")
    full = parts.groupBy("column", "replicate", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).withColumn("nr", F.sum("r").over(total)).withColumn("nc", F.sum("c").over(total))
    p, q = (F.greatest(F.col(k) / F.col(n), 1 / (2 * F.col(n))) for k, n in (("r", "nr"), ("c", "nc")))
    null = full.groupBy("column", "replicate").agg(F.round(F.sum((q - p) * F.log(q / p)), 9).alias("psi"))
    tests = null.join(observed, "column").groupBy("column", F.col("observed").alias("psi")).agg(F.count_if(F.col("psi") >= F.col("observed")).alias("as_large"), F.count("*").alias("replicates"))
    tests = benjamini_hochberg(tests.withColumn("p", (F.col("as_large") + 1) / (F.col("replicates") + 1)), "p", ["column"])
    return tests.withColumn("significant", F.col("q") <= ALPHA)


def categorical_js(rows: DataFrame) -> DataFrame:
    """rows (side, category) -> js (bits), appeared, vanished, n_reference, n_current."""
    counts = rows.groupBy("category").agg(F.count_if(F.expr("side = 'reference'")).alias("r"), F.count_if(F.expr("side = 'current'")).alias("c"))
    total = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    both = counts.crossJoin(F.broadcast(total)).where("nr > 0 and nc > 0")
    return both.groupBy(F.col("nr").alias("n_reference"), F.col("nc").alias("n_current")).agg(
        F.round(F.sum(js_bits(F.col("r") / F.col("nr"), F.col("c") / F.col("nc"))), 9).alias("js"), F.count_if(F.expr("r = 0")).alias("appeared"), F.count_if(F.expr("c = 0")).alias("vanished")
    )


def permuted_sides(ids: DataFrame, n: int, count: int, seed: str) -> DataFrame:
    """ids (id, …) -> with replicate and side: the first n in the order of a hash of seed, replicate and id are the reference.

    Rows are not sorted: counts by the hash's first byte tell which byte holds the n-th, and only its rows are ranked.
    """
    rows = ids.repartition(ids.sparkSession.sparkContext.defaultParallelism, "id").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    rows = rows.withColumn("__key", F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col("id").cast("string")).cast("binary"), 256)).withColumn("__head", F.substring("__key", 1, 2))
    upto = F.sum("k").over(Window.partitionBy("replicate").orderBy("__head"))
    heads = rows.groupBy("replicate", "__head").agg(F.count("*").alias("k")).withColumn("left", n - upto + F.col("k")).where("left > 0 and left <= k")
    place = F.row_number().over(Window.partitionBy("replicate").orderBy("__key", "id"))
    near = rows.select("replicate", "__head", "__key", "id").join(F.broadcast(heads), ["replicate", "__head"]).withColumn("place", place)  # a row for each replicate
    last = written(near.where("place = left").select("replicate", F.col("__key").alias("__last"), F.col("id").alias("__last_id")), "last")
    first = (F.col("__key") < F.col("__last")) | (F.col("__key") == F.col("__last")) & (F.col("id") <= F.col("__last_id"))
    return rows.join(F.broadcast(last), "replicate").withColumn("side", F.when(first, "reference").otherwise("current")).drop("__key", "__head", "__last", "__last_id")  # a row for each replicate


def categorical_permutation_test(rows: DataFrame, count: int = 199, seed: str = "shift") -> DataFrame:
    """rows (id, side, category) -> the observed divergence, and p = (replicates as large + 1) / (count + 1).

    Replicates come from relabelled_sums(): rows are counted by category for all of them in one pass.
    """
    observed = written(categorical_js(rows), "js")
    sizes = observed.select("n_reference", "n_current").first()
    n = sizes.n_reference if sizes else 0
    pool = rows.select("id", F.col("category").cast("string").alias("label"), F.array().cast("array<double>").alias("x"))
    drawn = relabelled_sums(pool, n, n + (sizes.n_current if sizes else 0), count, seed).where("at = 0").select("replicate", F.col("label").alias("category"), F.col("value").cast("long").alias("r"))
    whole = rows.groupBy(F.col("category").cast("string").alias("category")).agg(F.count("*").alias("k"))
    every = whole.crossJoin(rows.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("replicate")))  # categories and replicates
    same = (every.replicate == drawn.replicate) & every.category.eqNullSafe(drawn.category)
    counts = every.join(drawn, same, "left").select(every.replicate, every.category, F.coalesce("r", F.lit(0)).alias("r"), (F.col("k") - F.coalesce("r", F.lit(0))).alias("c"))
    total = Window.partitionBy("replicate")
    parts = counts.withColumn("nr", F.sum("r").over(total)).withColumn("nc", F.sum("c").over(total))
    null = parts.groupBy("replicate").agg(F.round(F.sum(js_bits(F.col("r") / F.col("nr"), F.col("c") / F.col("nc"))), 9).alias("null_js"))
    out = null.crossJoin(F.broadcast(observed)).groupBy("js", "appeared", "vanished", "n_reference", "n_current").agg(F.count_if(F.expr("null_js >= js")).alias("as_large"), F.count("*").alias("replicates"))
    return out.withColumn("p", F.round((F.col("as_large") + 1) / (F.col("replicates") + 1), 9)).withColumn("significant", F.col("p") <= ALPHA)


def mean_shift(rows: DataFrame, block: int) -> DataFrame:
    """rows (side, vector) -> by block of coordinates: squared change of the mean, its share, and whether it moved."""
    parts = rows.select("side", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg(F.when(F.col("side") == "reference", F.col("x").cast("double"))).alias("a"), F.avg(F.when(F.col("side") == "current", F.col("x").cast("double"))).alias("b"))
    blocks = means.groupBy(F.floor(F.col("i") / block).cast("int").alias("block")).agg(F.sum((F.col("b") - F.col("a")) ** 2).alias("change"))
    share = F.col("change") / F.sum("change").over(Window.partitionBy(F.lit(0)))
    return blocks.select("block", F.round("change", 9).alias("change"), F.round(share, 6).alias("share"), (share >= MOVED).alias("moved"))


def subsample(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """At most `most` rows of each side, by hash of the id: the test's stated cap, reported with what there was."""
    order = Window.partitionBy("side").orderBy(F.sha2(F.col("id").cast("string").cast("binary"), 256), "id")
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).drop("__place")


def energy_statistic(rows: DataFrame) -> DataFrame:
    """rows (id, side, vector), at most MOST_ROWS a side -> n, m, statistic nm / (n + m) (2 E|XY| - E|XX'| - E|YY'|)."""
    from plumbline.functions.statistics import dot

    few = subsample(rows).select("id", "side", "vector", dot(F.col("vector"), F.col("vector")).alias("s"))
    a, b = (few.withColumnsRenamed({c: f"{c}_{x}" for c in few.columns}) for x in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where("id_a != id_b")  # MOST_ROWS rows a side
    far = F.sqrt(F.greatest(F.lit(0.0), F.col("s_a") + F.col("s_b") - 2 * dot(F.col("vector_a"), F.col("vector_b"))))
    sums = pairs.withColumn("far", far).agg(*(F.sum(F.when((F.col("side_a") == x) & (F.col("side_b") == y), F.col("far"))).alias(n) for x, y, n in (("reference", "current", "xy"), ("reference", "reference", "xx"), ("current", "current", "yy"))))
    sizes = few.agg(F.count_if(F.expr("side = 'reference'")).alias("n"), F.count_if(F.expr("side = 'current'")).alias("m"))
    n, m = F.col("n"), F.col("m")
    value = n * m / (n + m) * (2 * F.col("xy") / (n * m) - F.col("xx") / (n * (n - 1)) - F.col("yy") / (m * (m - 1)))
    enough = (n >= LEAST_ROWS) & (m >= LEAST_ROWS)
    return sizes.crossJoin(sums).select("n", "m", F.when(enough, "ASSESSED").otherwise("INSUFFICIENT_SAMPLE").alias("status"), F.round(F.when(enough, value), 6).alias("statistic"))


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = subsample(rows).orderBy("side", "id").select("side", "vector").collect()  # MOST_ROWS rows a side
    return np.array([r.side == "reference" for r in got]), np.array([r.vector for r in got], float)


def energy_permutation_test(rows: DataFrame, count: int = PERMUTATIONS, seed: int = 20260917) -> DataFrame:
    """Permutation null of the energy statistic: the pooled distances are computed once, replicates run on the executors."""
    spark = rows.sparkSession
    side, x = _matrix(rows)
    n, m = int(side.sum()), int((~side).sum())
    if min(n, m) < LEAST_ROWS or count < LEAST_PERMUTATIONS:
        status = "INSUFFICIENT_SAMPLE" if min(n, m) < LEAST_ROWS else "NOT_ASSESSED"
        return spark.createDataFrame([(status, n, m, None, None, None)], "status string, n int, m int, statistic double, p double, effect double")
    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(far, 0)
    shared = spark.sparkContext.broadcast((far, side))  # (2 * MOST_ROWS) squared numbers

    def statistic(far: np.ndarray, s: np.ndarray) -> float:
        a, b = s.astype(float), (~s).astype(float)
        return n * m / (n + m) * (2 * (a @ far @ b) / (n * m) - (a @ far @ a) / (n * (n - 1)) - (b @ far @ b) / (m * (m - 1)))

    def run(batches):
        import pyarrow as pa

        far, side = shared.value
        for batch in batches:
            out = [statistic(far, np.random.default_rng([seed, b]).permutation(side)) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.float64())})

    observed = statistic(far, side)
    null = spark.range(count).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "value double")
    out = null.agg(F.count_if(F.col("value") >= observed).alias("as_large"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return out.select(F.lit("ASSESSED").alias("status"), F.lit(n).alias("n"), F.lit(m).alias("m"), F.lit(observed).alias("statistic"), ((F.col("as_large") + 1) / (count + 1)).alias("p"), F.try_divide(F.lit(observed) - F.col("mean"), F.col("sd")).alias("effect"))


def covariance_shift(rows: DataFrame, components: int = 8, count: int = 199, seed: int = 20260917) -> DataFrame:
    """Log-determinant ratio of a held-out half of the reference and the current side, in the other half's eigenbasis.

    Covariances are sums of products over all rows, for each replicate's random sides too.
    """
    spark, kind = rows.sparkSession, "status string, components int, statistic double, p double"
    sizes = {r.side: r["count"] for r in rows.groupBy("side").count().collect()}
    n, m = sizes.get("reference", 0), sizes.get("current", 0)
    if n < 2 * 5 * components or m < 5 * components:
        return spark.createDataFrame([("INSUFFICIENT_SAMPLE", components, None, None)], kind)
    halves = written(permuted_sides(rows.where("side = 'reference'").select("id", "vector"), n // 2, 1, f"half {seed}"), "halves")
    _, centre, products = moments(halves.where("side = 'reference'"))
    basis = np.linalg.eigh(products)[1][:, -components:]
    pool = halves.where("side = 'current'").select("id", F.lit(True).alias("held"), "vector").union(rows.where("side = 'current'").select("id", F.lit(False), "vector"))

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                z = (batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) - centre) @ basis
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(z), pa.list_(pa.float64()))], ["id", "held", "z"])

    pool = written(pool.mapInArrow(project, f"id {rows.schema['id'].dataType.simpleString()}, held boolean, z array<double>"), "pool")
    z = [F.get("z", F.lit(i)) for i in range(components)]
    terms = [F.lit(1.0), *z, *(z[i] * z[j] for i in range(components) for j in range(i, components))]
    held = n - n // 2
    drawn = relabelled_sums(pool.select("id", F.lit(None).cast("string").alias("label"), F.array(*terms).alias("x")), held, held + m, count, f"covariance {seed}")
    got = {b: np.zeros(len(terms)) for b in range(1, count + 1)}
    for r in drawn.where(F.col("at") < len(terms)).collect():  # sums for each replicate
        got[r.replicate][r.at] = r.value
    for b, part in ((0, pool.where("held")), (-1, pool)):
        got[b] = np.array(part.agg(*(F.sum(x) for x in terms)).first(), float)

    def log_det(s: np.ndarray) -> float:
        cov = np.zeros((components, components))
        cov[np.triu_indices(components)] = s[1 + components :]
        cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(s[1 : 1 + components], s[1 : 1 + components]) / s[0]
        sign, value = np.linalg.slogdet(cov / (s[0] - 1))
        return value if sign > 0 else float("nan")

    ratio = {b: log_det(got[-1] - s) - log_det(s) for b, s in got.items() if b >= 0}
    observed = ratio.pop(0)
    if not np.isfinite(observed):
        return spark.createDataFrame([("NOT_ASSESSED", components, None, None)], kind)
    p = (sum(abs(v) >= abs(observed) for v in ratio.values()) + 1) / (count + 1)
    return spark.createDataFrame([("ASSESSED", components, float(observed), float(p))], kind)


#: Which feature blocks a change of an operational condition explains.
EXPLAINS = {
    "season": ("colour", "gradient", "structure"),
    "terrain": ("structure", "gradient", "colour"),
    "sensor": ("acquisition", "dct", "colour", "gradient"),
    "illumination": ("acquisition", "colour", "dct"),
    "acquisition_mode": ("acquisition", "colour", "dct", "structure"),
}


def context_changes(contexts: DataFrame) -> DataFrame:
    """contexts (pair, side, dimension, value) -> pair, dimension, change: changed, unchanged, one_sided."""
    sides = [contexts.where(F.col("side") == s).select("pair", "dimension", F.col("value").alias(s)) for s in ("reference", "current")]
    both = sides[0].join(sides[1], ["pair", "dimension"], "full")
    change = F.when(F.col("reference").isNull() | F.col("current").isNull(), "one_sided").when(F.col("reference") == F.col("current"), "unchanged").otherwise("changed")
    return both.select("pair", "dimension", change.alias("change"))


def explain(changes: DataFrame, moved: DataFrame) -> DataFrame:
    """changes (context_changes), moved (pair, block) -> pair, explained, unexplained, verdict of an observed shift."""
    spark = changes.sparkSession
    table = spark.createDataFrame([(d, list(b)) for d, b in EXPLAINS.items()], "dimension string, blocks array<string>")
    known = changes.where("change in ('changed', 'one_sided')").join(F.broadcast(table), "dimension", "left").groupBy("pair").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("blocks", F.array().cast("array<string>"))))).alias("can"))
    seen = moved.groupBy("pair").agg(F.array_sort(F.collect_set("block")).alias("moved"))
    out = seen.join(changes.groupBy("pair").agg(F.count("*").alias("declared")), "pair", "left").join(known, "pair", "left").withColumn("can", F.coalesce("can", F.array().cast("array<string>")))
    left = F.array_sort(F.array_except("moved", "can"))
    verdict = F.when(F.col("declared").isNull(), "SHIFT_DETECTED_NO_CONTEXT").when(F.size(left) == 0, "SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT").when(F.size(left) < F.size("moved"), "SHIFT_PARTIALLY_EXPLAINED").otherwise("SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT")
    return out.select("pair", F.array_sort(F.array_intersect("moved", "can")).alias("explained"), left.alias("unexplained"), verdict.alias("verdict"))

"""Queries of provenance, models, distribution shift and fusion; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import fusion, models, provenance, shift
from plumbline.plans.dataset_queries import table
from plumbline.plans.registry import register

# ---------------------------------------------------------------- provenance: events as logs, one for each user

_LOG_SQL = """
    e AS (SELECT user_id::VARCHAR AS log_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence FROM events),
    p AS (SELECT *, sha256(concat_ws('|', log_id, sequence::VARCHAR, event_type, round(value * 1000)::BIGINT::VARCHAR)) AS claimed,
                 sha256(concat_ws('|', log_id, sequence::VARCHAR, event_type, round((CASE WHEN event_id % 97 = 5 THEN value + 1 ELSE value END) * 1000)::BIGINT::VARCHAR)) AS digest FROM e),
    r AS (SELECT log_id, event_id AS line, sequence, digest, lag(claimed) OVER (PARTITION BY log_id ORDER BY event_id) AS previous, event_id, ts, event_type FROM p),
    k AS (SELECT * FROM r WHERE event_id % 211 <> 7),
    l AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line) - 1 AS position, lag(digest) OVER (PARTITION BY log_id ORDER BY line) AS before FROM k),
    c AS (SELECT *, CASE WHEN position = 0 THEN CASE WHEN previous IS NULL THEN 'GENESIS' ELSE 'ORPHANED' END WHEN previous IS NULL THEN 'BROKEN' WHEN previous = before THEN 'LINKED' ELSE 'BROKEN' END AS link, sequence = position AS in_sequence FROM l)
"""


def event_log(spark: SparkSession, sf_dir: str, kept_only: bool = True) -> DataFrame:
    """Events as a log for each user: some entries are altered after the fact (event_id % 97 = 5), some removed (% 211 = 7)."""
    from pyspark.sql import Window

    order = Window.partitionBy("log_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("log_id"), "event_id", "ts", "event_type", "value")
    rows = rows.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))

    def digest(value: F.Column) -> F.Column:
        return provenance.record_digest(F.col("log_id"), F.col("sequence"), F.col("event_type"), F.round(value * 1000).cast("long"))

    rows = rows.withColumn("claimed", digest(F.col("value"))).withColumn("digest", digest(F.when(F.col("event_id") % 97 == 5, F.col("value") + 1).otherwise(F.col("value"))))
    rows = rows.withColumn("previous", F.lag("claimed").over(order)).withColumn("line", F.col("event_id"))
    rows = rows.where("event_id % 211 != 7") if kept_only else rows
    return rows.select("log_id", "line", "sequence", "digest", "previous", "event_id", "ts", "event_type")


@register("prov_chain", f"WITH {_LOG_SQL} SELECT log_id, line, sequence, position, link, in_sequence FROM c")
def prov_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.chain_links(event_log(spark, sf_dir)).select("log_id", "line", "sequence", F.col("position").cast("long").alias("position"), "link", "in_sequence")


@register(
    "prov_truncation",
    f"""
    WITH {_LOG_SQL}, t AS (SELECT log_id, position, link, in_sequence, digest FROM c),
    g AS (SELECT log_id, count(*) AS n, count(*) FILTER (link NOT IN ('GENESIS', 'LINKED') OR NOT in_sequence) AS broken, arg_max(digest, position) AS head, bool_or(link = 'ORPHANED') AS front FROM t GROUP BY 1),
    a AS (SELECT log_id, arg_max(digest, sequence) AS a_head, count(*) AS a_n FROM r WHERE log_id::INT % 3 <> 0 AND (log_id::INT % 3 <> 2 OR sequence < 40) GROUP BY 1),
    x AS (SELECT DISTINCT t.log_id FROM t JOIN a ON a.log_id = t.log_id AND a.a_head = t.digest)
    SELECT g.log_id, n, broken, CASE WHEN broken > 0 THEN 'BROKEN' ELSE 'INTACT' END AS status,
           CASE WHEN front THEN 'FRONT_TRUNCATION_DETECTED' WHEN a_head IS NULL THEN 'NOT_DETECTABLE' WHEN a_head = head AND a_n = n THEN 'VERIFIED_COMPLETE'
                WHEN x.log_id IS NOT NULL AND a_head <> head THEN 'ANCHOR_STALE' WHEN x.log_id IS NOT NULL THEN 'ANCHOR_MISMATCH' WHEN n < a_n THEN 'TRUNCATION_DETECTED' ELSE 'ANCHOR_MISMATCH' END AS truncation
    FROM g LEFT JOIN a USING (log_id) LEFT JOIN x USING (log_id)
    """,
)
def prov_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs against anchors of the logs as they were: none for a third of them, old ones for another."""
    whole = event_log(spark, sf_dir, kept_only=False)
    kept = whole.where("cast(log_id as int) % 3 != 0 and (cast(log_id as int) % 3 != 2 or sequence < 40)")
    anchors = kept.groupBy("log_id").agg(F.max_by("digest", "sequence").alias("head"), F.count("*").alias("entries"))
    return provenance.chain_summary(provenance.chain_links(event_log(spark, sf_dir)), anchors)


_SHOWN_SQL = """
    s AS (SELECT event_id AS seen, sha256(concat_ws('|', event_id::VARCHAR, event_type)) AS digest, (user_id % 5)::VARCHAR AS key_id, event_id::VARCHAR AS nonce, user_id::VARCHAR AS log_id, event_id AS sequence, sha256(concat_ws('|', event_type, round(value * 100)::BIGINT::VARCHAR)) AS subject FROM events
          UNION ALL SELECT event_id + 1000000000, sha256(concat_ws('|', event_id::VARCHAR, event_type)), (user_id % 5)::VARCHAR, event_id::VARCHAR, user_id::VARCHAR, event_id, sha256(concat_ws('|', event_type, round(value * 100)::BIGINT::VARCHAR)) FROM events WHERE event_id % 41 = 3
          UNION ALL SELECT event_id + 2000000000, sha256(concat_ws('|', 'n', event_id::VARCHAR)), (user_id % 5)::VARCHAR, event_id::VARCHAR, 'x' || user_id, event_id, NULL FROM events WHERE event_id % 43 = 4
          UNION ALL SELECT event_id + 3000000000, sha256(concat_ws('|', 's', event_id::VARCHAR)), NULL, NULL, user_id::VARCHAR, event_id, NULL FROM events WHERE event_id % 47 = 5)
"""


def shown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, with some shown again: as they are, with a used nonce, or in a slot that is taken."""
    rows = table(spark, sf_dir, "events")
    digest = provenance.record_digest
    key, log, nonce = (F.col("user_id") % 5).cast("string"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    subject = digest(F.col("event_type"), F.round(F.col("value") * 100).cast("long"))

    def part(where: str, shift_: int, d: F.Column, k: F.Column, n: F.Column, lg: F.Column, s: F.Column) -> DataFrame:
        return rows.where(where).select((F.col("event_id") + shift_).alias("seen"), d.alias("digest"), k.alias("key_id"), n.alias("nonce"), lg.alias("log_id"), F.col("event_id").alias("sequence"), s.alias("subject"))

    none = F.lit(None).cast("string")
    own = digest(F.col("event_id"), F.col("event_type"))
    out = part("true", 0, own, key, nonce, log, subject)
    out = out.union(part("event_id % 41 = 3", 1_000_000_000, own, key, nonce, log, subject))
    out = out.union(part("event_id % 43 = 4", 2_000_000_000, digest(F.lit("n"), F.col("event_id")), key, nonce, F.concat(F.lit("x"), log), none))
    return out.union(part("event_id % 47 = 5", 3_000_000_000, digest(F.lit("s"), F.col("event_id")), none, none, log, none))


@register(
    "replay_verdicts",
    f"""
    WITH {_SHOWN_SQL}, w AS (SELECT *, lag(seen) OVER (PARTITION BY digest ORDER BY seen) AS d, CASE WHEN key_id IS NOT NULL AND nonce IS NOT NULL THEN lag(seen) OVER (PARTITION BY key_id, nonce ORDER BY seen) END AS n,
        CASE WHEN log_id IS NOT NULL THEN lag(seen) OVER (PARTITION BY log_id, sequence ORDER BY seen) END AS q, CASE WHEN subject IS NOT NULL THEN lag(seen) OVER (PARTITION BY subject ORDER BY seen) END AS u FROM s)
    SELECT seen, digest, key_id, nonce, log_id, sequence, subject, CASE WHEN d IS NOT NULL THEN 'REPLAY_EXACT' WHEN n IS NOT NULL THEN 'NONCE_REUSE' WHEN q IS NOT NULL THEN 'SEQUENCE_COLLISION' WHEN u IS NOT NULL THEN 'DUPLICATE_SUBJECT' ELSE 'FIRST_OBSERVATION' END AS verdict, coalesce(d, n, q, u) AS prior FROM w
    """,
)
def replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.replay_verdicts(shown_records(spark, sf_dir))


def _order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records (status as model, priority as configuration) against expectations, a third of which are absent."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("model_id"), F.when(F.col("o_orderkey") % 50 != 9, F.col("o_orderpriority")).alias("inference_digest"),
        F.round("o_totalprice").cast("long").cast("string").alias("output_digest"), (F.col("o_custkey") % 4).cast("string").alias("key_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("signed_at"),
    )
    expected = rows.select("record", F.when(F.col("record") % 3 != 0, F.when(F.col("record") % 31 == 0, "X").otherwise(F.col("model_id"))).alias("model_id"), F.coalesce("inference_digest", F.lit("?")).alias("inference_digest"), F.when(F.col("record") % 37 == 0, "0").otherwise(F.col("output_digest")).alias("output_digest"))
    trust = spark.createDataFrame([("0", "TRUSTED", "1990-01-01", "1997-01-01", "inference"), ("1", "REVOKED", None, None, "any"), ("2", "TRUSTED", "not a time", None, "report")], "key_id string, status string, valid_from string, valid_until string, purpose string")
    return provenance.expectation_checks(rows, expected, "record").unionByName(provenance.key_checks(rows, trust, "record"))


_CHECKS_SQL = """
    o AS (SELECT o_orderkey AS record, o_orderstatus AS m, CASE WHEN o_orderkey % 50 <> 9 THEN o_orderpriority END AS i, round(o_totalprice)::BIGINT::VARCHAR AS t, o_custkey % 4 AS key, o_orderdate AS signed FROM orders),
    k AS (SELECT record, 'model_id_match' AS "check", CASE WHEN record % 3 = 0 THEN 'NOT_CHECKED' WHEN record % 31 = 0 THEN 'FAIL' ELSE 'PASS' END AS outcome, 'MODEL_MISMATCH' AS code FROM o
          UNION ALL SELECT record, 'inference_digest_match', CASE WHEN i IS NULL THEN 'FAIL' ELSE 'PASS' END, CASE WHEN i IS NULL THEN 'MISSING_FIELD' ELSE 'CONFIGURATION_MISMATCH' END FROM o
          UNION ALL SELECT record, 'output_digest_match', CASE WHEN record % 37 = 0 THEN 'FAIL' ELSE 'PASS' END, 'OUTPUT_MISMATCH' FROM o
          UNION ALL SELECT record, 'key_known', CASE WHEN key = 3 THEN 'FAIL' ELSE 'PASS' END, 'UNKNOWN_KEY' FROM o
          UNION ALL SELECT record, 'key_trusted', CASE WHEN key IN (0, 2) THEN 'PASS' ELSE 'FAIL' END, CASE WHEN key = 1 THEN 'REVOKED_KEY' ELSE 'UNKNOWN_KEY' END FROM o
          UNION ALL SELECT record, 'key_within_validity_window', CASE WHEN key = 3 THEN 'NOT_CHECKED' WHEN key = 0 AND (signed < TIMESTAMP '1990-01-01' OR signed > TIMESTAMP '1997-01-01') THEN 'FAIL' ELSE 'PASS' END, CASE WHEN signed < TIMESTAMP '1990-01-01' THEN 'KEY_NOT_YET_VALID' ELSE 'KEY_EXPIRED' END FROM o
          UNION ALL SELECT record, 'key_purpose_permitted', CASE WHEN key = 3 THEN 'NOT_CHECKED' WHEN key = 2 THEN 'FAIL' ELSE 'PASS' END, 'KEY_PURPOSE_MISMATCH' FROM o)
"""


@register("check_matrix", f"""WITH {_CHECKS_SQL} SELECT "check", count(*) FILTER (outcome = 'PASS') AS pass, count(*) FILTER (outcome = 'FAIL') AS fail, count(*) FILTER (outcome = 'NOT_CHECKED') AS not_checked, 0::BIGINT AS observed FROM k GROUP BY 1""")
def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.verification_matrix(_order_checks(spark, sf_dir))


@register(
    "prov_findings",
    f"""
    WITH {_CHECKS_SQL}, f AS (SELECT record, code AS failure, count(*) AS evidence FROM k WHERE outcome = 'FAIL' GROUP BY ALL)
    SELECT record, failure, CASE WHEN failure IN ('UNKNOWN_KEY', 'REVOKED_KEY', 'KEY_EXPIRED', 'KEY_NOT_YET_VALID', 'KEY_PURPOSE_MISMATCH') THEN 'provenance_key_trust' ELSE 'inference_tampering' END AS attack_class,
           CASE WHEN failure IN ('MODEL_MISMATCH', 'OUTPUT_MISMATCH') THEN 'CRITICAL' WHEN failure IN ('CONFIGURATION_MISMATCH', 'UNKNOWN_KEY', 'REVOKED_KEY') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, evidence, 'SUPPORTED' AS coverage,
           CASE WHEN failure IN ('MODEL_MISMATCH', 'OUTPUT_MISMATCH', 'CONFIGURATION_MISMATCH', 'UNKNOWN_KEY', 'REVOKED_KEY') THEN 'QUARANTINE' ELSE 'REVIEW' END AS disposition,
           CASE WHEN failure IN ('MODEL_MISMATCH', 'OUTPUT_MISMATCH', 'CONFIGURATION_MISMATCH', 'UNKNOWN_KEY', 'REVOKED_KEY') THEN 'D-100' ELSE 'D-200' END AS disposition_rule FROM f
    """,
)
def prov_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.failure_findings(_order_checks(spark, sf_dir), "record")


# ---------------------------------------------------------------- shift: first against second half of January

_SIDES_SQL = "e AS (SELECT event_id AS id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS side, value, event_type, (user_id)::DOUBLE AS user_id FROM events)"


def event_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "reference").otherwise("current")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), side.alias("side"), "value", "event_type", F.col("user_id").cast("double").alias("user_id"))


@register(
    "psi_marginal",
    f"""
    WITH {_SIDES_SQL}, v AS (SELECT side, 'value' AS "column", value FROM e UNION ALL SELECT side, 'user_id', user_id FROM e),
    q AS (SELECT "column", quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM v WHERE side = 'reference' GROUP BY 1),
    d AS (SELECT "column", list_sort(list_distinct(q)) AS edges FROM q), b AS (SELECT v.*, len(edges) - 1 AS bins, len(list_filter(edges[2:-2], lambda x: x <= value)) AS bin FROM v JOIN d USING ("column")),
    a AS (SELECT "column", len(edges) - 1 AS bins, unnest(range(len(edges) - 1)) AS bin FROM d),
    c AS (SELECT a."column", a.bins, a.bin, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM a LEFT JOIN b ON a."column" = b."column" AND a.bin = b.bin GROUP BY ALL),
    w AS (SELECT *, sum(r) OVER (PARTITION BY "column") AS nr, sum(c) OVER (PARTITION BY "column") AS nc FROM c),
    p AS (SELECT *, greatest(r / nr, 1 / (2 * nr)) AS p, greatest(c / nc, 1 / (2 * nc)) AS q FROM w)
    SELECT "column", bins::INT AS bins, nr::BIGINT AS n_reference, nc::BIGINT AS n_current, round(sum((q - p) * ln(q / p)), 9) AS psi FROM p GROUP BY ALL
    """,
)
def psi_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_sides(spark, sf_dir)
    return shift.psi(rows.select("side", F.lit("value").alias("column"), "value").union(rows.select("side", F.lit("user_id"), "user_id")))


_JS_SQL = "CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END"


@register(
    "js_categorical",
    f"""
    WITH {_SIDES_SQL}, c AS (SELECT event_type, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM e GROUP BY 1),
    p AS (SELECT *, r / sum(r) OVER () AS p, c / sum(c) OVER () AS q, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM c)
    SELECT any_value(nr)::BIGINT AS n_reference, any_value(nc)::BIGINT AS n_current, round(sum({_JS_SQL}), 9) AS js, count(*) FILTER (r = 0) AS appeared, count(*) FILTER (c = 0) AS vanished FROM p
    """,
)
def js_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.categorical_js(event_sides(spark, sf_dir).withColumnRenamed("event_type", "category"))


@register(
    "perm_test",
    f"""
    WITH {_SIDES_SQL}, n AS (SELECT count(*) FILTER (side = 'reference') AS n, count(*) AS m FROM e),
    s AS (SELECT b, event_type, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY sha256('shift|' || b || '|' || id), id) <= n THEN 'r' ELSE 'c' END AS side FROM e, n, range(1, 100) t(b)),
    o AS (SELECT 0 AS b, event_type, left(side, 1) AS side FROM e UNION ALL SELECT * FROM s),
    c AS (SELECT b, event_type, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'c') AS c FROM o GROUP BY ALL),
    p AS (SELECT *, r / sum(r) OVER (PARTITION BY b) AS p, c / sum(c) OVER (PARTITION BY b) AS q FROM c),
    j AS (SELECT b, round(sum({_JS_SQL}), 9) AS js, count(*) FILTER (r = 0) AS appeared, count(*) FILTER (c = 0) AS vanished FROM p GROUP BY b),
    x AS (SELECT js, appeared, vanished, (SELECT n FROM n) AS n_reference, (SELECT m - n FROM n) AS n_current, (SELECT count(*) FROM j k WHERE k.b > 0 AND k.js >= j.js) AS as_large FROM j WHERE b = 0)
    SELECT *, 99::BIGINT AS replicates, round((as_large + 1) / 100, 9) AS p, round((as_large + 1) / 100, 9) <= 0.01 AS significant FROM x
    """,
)
def perm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.categorical_permutation_test(event_sides(spark, sf_dir).withColumnRenamed("event_type", "category"), 99)


def vector_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "reference").otherwise("current").alias("side"), F.col("embedding").alias("vector"))


@register(
    "mean_shift_blocks",
    """
    WITH x AS (SELECT label < 5 AS ref, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    m AS (SELECT i, avg(x) FILTER (ref) AS a, avg(x) FILTER (NOT ref) AS b FROM x GROUP BY i), s AS (SELECT (i // 16)::INT AS block, sum((b - a) * (b - a)) AS c FROM m GROUP BY 1)
    SELECT block, round(c, 9) AS change, round(c / sum(c) OVER (), 6) AS share, c / sum(c) OVER () >= 0.15 AS moved FROM s
    """,
)
def mean_shift_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.mean_shift(vector_sides(spark, sf_dir), 16)


@register(
    "energy_stat",
    """
    WITH v AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'r' ELSE 'c' END AS s, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256(id::VARCHAR), id) AS rn FROM v) WHERE rn <= 400),
    n AS (SELECT count(*) FILTER (s = 'r') AS n, count(*) FILTER (s = 'c') AS m FROM f),
    d AS (SELECT a.s AS x, b.s AS y, sum(list_distance(a.v, b.v)) AS d FROM f a JOIN f b ON a.id <> b.id GROUP BY ALL)
    SELECT n, m, CASE WHEN n >= 20 AND m >= 20 THEN 'ASSESSED' ELSE 'INSUFFICIENT_SAMPLE' END AS status, CASE WHEN n >= 20 AND m >= 20 THEN round(n * m / (n + m) * (2 * (SELECT d FROM d WHERE x = 'r' AND y = 'c') / (n * m) - (SELECT d FROM d WHERE x = 'r' AND y = 'r') / (n * (n - 1)) - (SELECT d FROM d WHERE x = 'c' AND y = 'c') / (m * (m - 1))), 6) END AS statistic FROM n
    """,
)
def energy_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.energy_statistic(vector_sides(spark, sf_dir))


@register("energy_permutations")
def energy_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.energy_permutation_test(vector_sides(spark, sf_dir))


@register("covariance_shift")
def covariance_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.covariance_shift(vector_sides(spark, sf_dir))


@register(
    "context_explained",
    """
    WITH n AS (SELECT n_nationkey::VARCHAR AS pair, n_nationkey AS k FROM nation),
    c AS (SELECT pair, k % 2 = 0 AS season, k % 3 = 0 AS sensor, k % 5 <> 4 AS declared FROM n),
    x AS (SELECT pair, declared, list_distinct(CASE WHEN season AND declared THEN ['colour', 'gradient', 'structure'] ELSE [] END || CASE WHEN sensor AND declared THEN ['acquisition', 'dct', 'colour', 'gradient'] ELSE [] END) AS can,
                 list_sort(['colour'] || CASE WHEN pair::INT % 4 = 1 THEN ['dct'] ELSE [] END || CASE WHEN pair::INT % 7 = 2 THEN ['structure'] ELSE [] END) AS moved FROM c),
    y AS (SELECT *, list_sort(list_filter(moved, lambda b: NOT list_contains(can, b))) AS u FROM x)
    SELECT pair, list_sort(list_filter(moved, lambda b: list_contains(can, b))) AS explained, u AS unexplained,
           CASE WHEN NOT declared THEN 'SHIFT_DETECTED_NO_CONTEXT' WHEN len(u) = 0 THEN 'SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT' WHEN len(u) < len(moved) THEN 'SHIFT_PARTIALLY_EXPLAINED' ELSE 'SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT' END AS verdict FROM y
    """,
)
def context_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pairs of populations: season and sensor as declared conditions, and blocks that moved."""
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("pair"), F.col("n_nationkey").alias("k"))
    declared = pairs.where("k % 5 != 4")
    dims = F.explode(F.array(F.struct(F.lit("season").alias("dimension"), (F.col("k") % 2 == 0).alias("differs")), F.struct(F.lit("sensor").alias("dimension"), (F.col("k") % 3 == 0).alias("differs")))).alias("d")
    rows = declared.select("pair", dims).select("pair", "d.*")
    contexts = rows.select("pair", F.lit("reference").alias("side"), "dimension", F.lit("a").alias("value")).union(rows.select("pair", F.lit("current"), "dimension", F.when(F.col("differs"), "b").otherwise("a")))
    k = F.col("k")
    moved = pairs.select("pair", F.explode(F.array_compact(F.array(F.lit("colour"), F.when(k % 4 == 1, "dct"), F.when(k % 7 == 2, "structure")))).alias("block"))
    return shift.explain(shift.context_changes(contexts), moved)


# ---------------------------------------------------------------- models: embeddings as tensors and as predictions


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    return rows.select(F.format_string("layer%d.%d", "label", "vec_id").alias("name"), F.concat(F.lit("Conv/"), F.col("label").cast("string")).alias("peer_group"), F.col("embedding").alias("values"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("vec_id").alias("id"))


_STATS_SQL = """
    t AS (SELECT printf('layer%d.%d', label, vec_id) AS name, 'Conv/' || label AS peer_group, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
    x AS (SELECT name, peer_group, unnest(v) AS x FROM t), m AS (SELECT name, peer_group, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2, max(abs(x)) AS max_abs, avg((abs(x) < 1e-8)::INT) AS sparsity FROM x GROUP BY ALL),
    s AS (SELECT m.*, k.kurtosis, k.beyond FROM m JOIN (SELECT name, avg(((x - mean) / std) ** 4) - 3 AS kurtosis, avg((abs((x - mean) / std) > 6)::INT) AS beyond FROM x JOIN m USING (name) GROUP BY name) k USING (name))
"""


@register("param_stats", f"WITH {_STATS_SQL} SELECT name, n, round(mean, 9) AS mean, round(std, 9) AS std, round(l1, 9) AS l1, round(l2, 9) AS l2, round(max_abs, 9) AS max_abs, round(sparsity, 9) AS sparsity, round(kurtosis, 6) AS kurtosis, round(beyond, 9) AS beyond_6_sigma, 0::BIGINT AS non_finite FROM s")
def param_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.tensor_stats(tensors(spark, sf_dir))
    return out.select("name", "n", *(F.round(c, 9).alias(c) for c in ("mean", "std", "l1", "l2", "max_abs", "sparsity")), F.round("kurtosis", 6).alias("kurtosis"), F.round("beyond_6_sigma", 9).alias("beyond_6_sigma"), "non_finite")


@register(
    "peer_outliers",
    f"""
    WITH {_STATS_SQL.replace("embedding::DOUBLE[] AS v", "CASE WHEN vec_id % 97 = 11 THEN [embedding[1]::DOUBLE * 80] || embedding[2:]::DOUBLE[] ELSE embedding::DOUBLE[] END AS v")}, r AS (SELECT name, peer_group, unnest(['max_abs', 'kurtosis', 'sparsity']) AS metric, unnest([max_abs, kurtosis, sparsity]) AS value FROM s),
    d AS (SELECT *, median(value) OVER (PARTITION BY peer_group, metric) AS md, count(*) OVER (PARTITION BY peer_group, metric) AS n FROM r),
    a AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY peer_group, metric) AS mad FROM d WHERE n >= 6),
    z AS (SELECT name, peer_group, metric, value, round((value - md) / CASE WHEN mad > 0 THEN mad * 1.4826 * CASE n WHEN 6 THEN 1.2 WHEN 7 THEN 1.14 WHEN 8 THEN 1.129 WHEN 9 THEN 1.107 ELSE n / (n - 0.8) END END, 6) AS z FROM a)
    SELECT name, peer_group, metric, round(value, 6) AS value, round(z, 2) AS z FROM z WHERE abs(z) >= 8
    """,
)
def peer_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors, in some of which the first value is eighty times what it was."""
    values = F.transform("values", lambda x: x.cast("double"))
    rows = tensors(spark, sf_dir).withColumn("values", F.when(F.col("id") % 97 == 11, F.concat(F.array(F.get(values, F.lit(0)) * 80), F.slice(values, 2, F.size("values") - 1))).otherwise(values))
    stats = models.tensor_stats(rows).join(rows.select("name", "peer_group"), "name")
    return models.peer_outliers(stats, ("max_abs", "kurtosis", "sparsity")).select("name", "peer_group", "metric", F.round("value", 6).alias("value"), F.round("z", 2).alias("z"))


@register(
    "param_compare",
    """
    WITH a AS (SELECT printf('layer%d.%d', label, vec_id) AS name, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
    b AS (SELECT name, id, CASE WHEN id % 5 = 0 THEN list_transform(v, lambda x: x * 1.5) ELSE v END AS v FROM a),
    j AS (SELECT coalesce(x.name, y.name) AS name, x.v AS p, y.v AS q, x.id % 7 = 3 AS reshaped FROM (SELECT * FROM b WHERE id % 11 <> 1) x FULL JOIN (SELECT * FROM a WHERE id % 13 <> 2) y USING (name)),
    s AS (SELECT *, CASE WHEN q IS NULL THEN 'only_supplied' WHEN p IS NULL THEN 'only_reference' WHEN reshaped THEN 'reshaped' WHEN p = q THEN 'identical' ELSE 'changed' END AS status FROM j),
    d AS (SELECT *, CASE WHEN status = 'changed' THEN list_transform(list_zip(p, q), lambda z: z[1] - z[2]) END AS d FROM s)
    SELECT name, status, CASE WHEN status = 'changed' THEN len(list_filter(d, lambda x: abs(x) > 1e-8))::INT END AS changed_elements, CASE WHEN status = 'changed' THEN round(len(list_filter(d, lambda x: abs(x) > 1e-8)) / len(d), 8) END AS changed_fraction,
           CASE WHEN status = 'changed' THEN round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 8) END AS absolute_l2, CASE WHEN status = 'changed' THEN round(sqrt(list_sum(list_transform(d, lambda x: x * x))) / sqrt(list_sum(list_transform(q, lambda x: x * x))), 8) END AS relative_l2, round(list_max(list_transform(d, lambda x: abs(x))), 8) AS max_absolute,
           CASE WHEN status = 'changed' THEN round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(p, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 8) END AS cosine FROM d
    """,
)
def param_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors against a copy in which some are scaled, reshaped, absent or new."""
    rows = tensors(spark, sf_dir).withColumn("values", F.transform("values", lambda x: x.cast("double")))
    reshaped = F.when(F.col("id") % 7 == 3, F.array(F.lit(4), F.lit(16))).otherwise(F.col("shape"))
    supplied = rows.where("id % 11 != 1").withColumn("values", F.when(F.col("id") % 5 == 0, F.transform("values", lambda x: x * 1.5)).otherwise(F.col("values"))).withColumn("shape", reshaped)
    return models.compare_tensors(supplied, rows.where("id % 13 != 2"))


def _probabilities(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """Softmax over four coordinates as a model's prediction for each vector (a probe)."""
    logits = F.transform(F.slice("embedding", first, 4), lambda x: F.exp(x.cast("double") * 4))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("probe"), F.format_string("c%d", F.col("label") % 3).alias("category"), logits.alias("e")).withColumn("probabilities", F.transform("e", lambda x: x / total)).drop("e")


@register(
    "js_models",
    """
    WITH s AS (SELECT vec_id, 'c' || (label % 3) AS category, list_transform(embedding[1:4]::DOUBLE[], lambda x: exp(x * 4)) AS p, list_transform(embedding[3:6]::DOUBLE[], lambda x: exp(x * 4)) AS q FROM embeddings WHERE label IS NOT NULL),
    n AS (SELECT category, list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM s),
    r AS (SELECT category, (list_position(p, list_max(p)) = list_position(q, list_max(q)))::INT AS same, greatest(0.0, least(1.0, list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) + 0.5 * z[2] * log2(z[2] / ((z[1] + z[2]) / 2)))))) AS js, list_max(p) - list_max(q) AS shift FROM n)
    SELECT coalesce(category, 'ALL') AS category, count(*) AS n, round(avg(same), 9) AS agreement, round(avg(js), 9) AS js_mean, round(median(js), 9) AS js_median, round(quantile_cont(js, 0.95), 9) AS js_p95, round(max(js), 9) AS js_max, round(avg(shift), 9) AS shift_mean, round(avg(abs(shift)), 9) AS shift_mean_abs FROM r GROUP BY GROUPING SETS ((), (category))
    """,
)
def js_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.compare_behaviour(_probabilities(spark, sf_dir, 1), _probabilities(spark, sf_dir, 3))


_FLIPS_SQL = "p AS (SELECT 't' || (vec_id % 7) AS trigger, list_position(embedding[1:4], list_max(embedding[1:4])) AS before, CASE WHEN vec_id % 7 = 1 AND vec_id % 10 < 8 THEN 2 ELSE list_position(embedding[3:6], list_max(embedding[3:6])) END AS after FROM embeddings)"


def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda a: F.array_position(F.slice("embedding", a, 4), F.array_max(F.slice("embedding", a, 4)))
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), (v % 7).cast("string")).alias("trigger"), top(1).alias("before"), F.when((v % 7 == 1) & (v % 10 < 8), 2).otherwise(top(3)).alias("after"))


@register(
    "targeted_transition",
    f"""
    WITH {_FLIPS_SQL}, w AS (SELECT trigger, count(*) AS n, count(*) FILTER (before <> after) AS flips FROM p GROUP BY 1),
    h AS (SELECT trigger, after AS target, count(*) AS hits, row_number() OVER (PARTITION BY trigger ORDER BY count(*) DESC, after) AS k FROM p WHERE before <> after GROUP BY trigger, after)
    SELECT w.trigger, n, flips, target, round(coalesce(hits, 0) / n, 9) AS success, round(coalesce(hits / nullif(flips, 0), 0), 9) AS concentration FROM w LEFT JOIN h ON h.trigger = w.trigger AND k = 1
    """,
)
def targeted_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.targeted_transitions(_flips(spark, sf_dir))


@register("metamorphic", f"WITH {_FLIPS_SQL} SELECT coalesce(trigger, 'ALL') AS kind, count(*) AS n, round(avg((before = after)::INT), 9) AS consistency FROM p GROUP BY GROUPING SETS ((), (trigger))")
def metamorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.metamorphic_consistency(_flips(spark, sf_dir).withColumnRenamed("trigger", "kind"))


@register(
    "structure_diff",
    """
    WITH a AS (SELECT p_partkey AS position, p_type AS op, p_size AS s, p_brand AS b FROM part WHERE p_partkey % 17 <> 3), b AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 19 = 4 THEN 'X' ELSE p_type END AS op, p_size AS s, p_brand AS b FROM part WHERE p_partkey % 23 <> 5)
    SELECT coalesce(a.position, b.position) AS position, CASE WHEN b.position IS NULL THEN 'added' WHEN a.position IS NULL THEN 'removed' WHEN a.op = b.op AND a.s = b.s AND a.b = b.b THEN 'same' ELSE 'changed' END AS status, a.op AS supplied_op, b.op AS reference_op FROM a FULL JOIN b ON a.position = b.position
    """,
)
def structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as layers of two models."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.col("p_type").alias("op_type"), F.col("p_size").alias("shape"), F.col("p_brand").alias("parameters"))
    changed = rows.where("position % 23 != 5").withColumn("op_type", F.when(F.col("position") % 19 == 4, "X").otherwise(F.col("op_type")))
    return models.structure_diff(rows.where("position % 17 != 3"), changed)


# ---------------------------------------------------------------- fusion: customers as findings of cases, one for each nation

_CASES_SQL = """
    f AS (SELECT c_nationkey::VARCHAR AS "case", c_custkey AS id, c_custkey % 5 AS d, (c_custkey * 7 + c_nationkey) % 9 AS a, c_custkey % 11 AS s, c_custkey % 4 AS b, round((c_custkey % 100) / 100, 2) AS confidence, c_custkey % 6 AS cov FROM customer WHERE c_custkey % 40 = c_nationkey),
    e AS (SELECT "case", 'd' || d AS detector, ['DATASET_DUPLICATION', 'DATASET_LABELLING', 'DATASET_METADATA', 'DISTRIBUTION_SHIFT', 'MODEL_IDENTITY', 'MODEL_BACKDOOR', 'PROVENANCE_INTEGRITY', 'PROVENANCE_TRUST', 'UNCLASSIFIED'][a + 1] AS family, CASE WHEN s < 4 THEN 0 WHEN s < 6 THEN 1 WHEN s < 9 THEN 2 WHEN s < 10 THEN 3 ELSE 4 END AS rank,
                 ['DETERMINISTIC', 'STATISTICAL', 'HEURISTIC_UNCALIBRATED', 'CALIBRATED'][b + 1] AS basis, confidence, cov <> 0 AS assessed FROM f),
    v AS (SELECT n_nationkey::VARCHAR AS "case", [NULL, 'NO_SHIFT_DETECTED', 'SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT', 'SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT', 'INSUFFICIENT_SAMPLE'][n_nationkey % 5 + 1] AS verdict, n_nationkey % 2 = 0 AS hd, n_nationkey % 3 <> 1 AS hm, n_nationkey % 4 <> 2 AS hp FROM nation),
    g AS (SELECT e.*, assessed AND rank >= 2 AND (basis = 'DETERMINISTIC' OR confidence >= 0.3) AS supporting FROM e),
    h AS (SELECT g.*, family = 'DATASET_LABELLING' AND (coalesce(verdict LIKE 'SHIFT%', false) OR bool_or(supporting AND family = 'DISTRIBUTION_SHIFT') OVER (PARTITION BY "case")) AS confounded FROM g LEFT JOIN v USING ("case"))
"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases, evidence and shift: customers stand for findings, nations for cases."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    classes = ("duplicate_flood", "label_flip", "dataset_tamper", "ood_insertion", "model_substitution", "model_backdoor", "inference_tampering", "provenance_key_trust", "unheard_of")
    s = key % 11
    found = table(spark, sf_dir, "customer").where("c_custkey % 40 = c_nationkey").select(
        nation.cast("string").alias("case"), F.concat(F.lit("F-"), key.cast("string")).alias("finding_id"), pick(classes, F.pmod(key * 7 + nation, F.lit(9))).alias("attack_class"), F.concat(F.lit("d"), (key % 5).cast("string")).alias("detector"),
        F.when(s < 4, "INFO").when(s < 6, "LOW").when(s < 9, "MEDIUM").when(s < 10, "HIGH").otherwise("CRITICAL").alias("severity"), F.round((key % 100) / 100, 2).alias("confidence"),
        pick(("DETERMINISTIC", "STATISTICAL", "HEURISTIC_UNCALIBRATED", "CALIBRATED"), key % 4).alias("basis"), F.when(key % 6 == 0, "NOT_ASSESSED").otherwise("SUPPORTED").alias("coverage"),
    )
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(n.cast("string").alias("case"), (n % 2 == 0).alias("has_data"), (n % 3 != 1).alias("has_model"), (n % 4 != 2).alias("has_provenance"), F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("NO_SHIFT_DETECTED", "SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT", "SHIFT_UNEXPLAINED_BY_DECLARED_CONTEXT", "INSUFFICIENT_SAMPLE"))), (n % 5 + 1).cast("int")).alias("verdict"))
    moved = nations.select("case", "verdict")
    return nations.drop("verdict"), fusion.evidence(found, moved), moved


@register(
    "evidence_groups",
    f"""WITH {_CASES_SQL} SELECT "case", family, count(*) AS n, count(*) FILTER (supporting) AS supporting, count(DISTINCT CASE WHEN supporting THEN detector END) AS corroboration, max(rank) FILTER (supporting)::INT AS top_rank,
        coalesce(bool_and(confounded) FILTER (supporting), false) AS confounded, count(*) FILTER (supporting) > 0 AND NOT coalesce(bool_and(confounded) FILTER (supporting), false) AS independent FROM h GROUP BY ALL""",
)
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.families(_cases(spark, sf_dir)[1]).withColumn("top_rank", F.col("top_rank").cast("int"))


_RULES_SQL = f"""{_CASES_SQL},
    x AS (SELECT v."case", any_value(verdict) AS v, any_value(hd) AS hd, any_value(hm) AS hm, any_value(hp) AS hp,
        count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND rank >= 3 AND family = 'PROVENANCE_INTEGRITY') AS pdh, count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND family = 'PROVENANCE_TRUST') AS pt, count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND family LIKE 'PROV%') AS pd, count(*) FILTER (supporting AND family LIKE 'PROV%') AS p,
        count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND rank >= 3 AND family = 'MODEL_IDENTITY') AS mdh, count(*) FILTER (supporting AND basis = 'CALIBRATED' AND rank >= 3 AND confidence >= 0.85 AND family = 'MODEL_BACKDOOR') AS mc, count(*) FILTER (supporting AND family LIKE 'MODEL%') AS m,
        count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND rank >= 3 AND family IN ('DATASET_METADATA', 'DATASET_DUPLICATION')) AS ddh, count(*) FILTER (supporting AND basis = 'DETERMINISTIC' AND rank >= 3 AND family LIKE 'DATASET%') AS dah, count(*) FILTER (supporting AND family LIKE 'DATASET%') AS d,
        count(*) FILTER (supporting AND NOT confounded AND family LIKE 'DATASET%') AS df, count(*) FILTER (supporting AND NOT confounded AND rank >= 3 AND family LIKE 'DATASET%') AS dfh, count(*) FILTER (supporting AND NOT confounded AND (family LIKE 'MODEL%' OR family LIKE 'PROV%')) AS o, count(*) FILTER (supporting AND family = 'DISTRIBUTION_SHIFT') AS sm
        FROM v LEFT JOIN h USING ("case") GROUP BY 1),
    y AS (SELECT "case", unnest([('PROV-000', 'PROVENANCE', 'NOT_ASSESSED', NOT hp), ('PROV-001', 'PROVENANCE', 'QUARANTINE', pdh > 0), ('PROV-002', 'PROVENANCE', 'QUARANTINE', pt > 0 AND pdh = 0), ('PROV-010', 'PROVENANCE', 'ACCEPT', hp AND pd = 0),
        ('MODEL-000', 'MODEL', 'NOT_ASSESSED', NOT hm), ('MODEL-001', 'MODEL', 'QUARANTINE', mdh > 0), ('MODEL-002', 'MODEL', 'QUARANTINE', mc > 0), ('MODEL-003', 'MODEL', 'REVIEW', m > 0 AND mdh = 0 AND mc = 0), ('MODEL-010', 'MODEL', 'ACCEPT', hm AND m = 0),
        ('DATA-000', 'DATASET', 'NOT_ASSESSED', NOT hd), ('DATA-001', 'DATASET', 'QUARANTINE', ddh > 0), ('DATA-002', 'DATASET', 'REVIEW', df > 0 AND dah = 0), ('DATA-003', 'DATASET', 'QUARANTINE', dfh > 0 AND o > 0), ('DATA-004', 'DATASET', 'REVIEW', d > 0 AND df = 0), ('DATA-010', 'DATASET', 'ACCEPT', hd AND d = 0),
        ('SHIFT-000', 'OPERATIONAL_CONTEXT', 'NOT_ASSESSED', v IS NULL), ('SHIFT-001', 'OPERATIONAL_CONTEXT', 'NOT_ASSESSED', coalesce(v = 'INSUFFICIENT_SAMPLE', false)), ('SHIFT-010', 'OPERATIONAL_CONTEXT', 'ACCEPT', coalesce(v = 'NO_SHIFT_DETECTED', false)),
        ('SHIFT-020', 'OPERATIONAL_CONTEXT', 'ACCEPT', coalesce(v LIKE 'SHIFT_C%', false) AND df = 0 AND o = 0), ('SHIFT-030', 'OPERATIONAL_CONTEXT', 'REVIEW', coalesce(v LIKE 'SHIFT_U%', false) AND df = 0 AND o = 0), ('SHIFT-040', 'OPERATIONAL_CONTEXT', 'REVIEW', coalesce(v LIKE 'SHIFT%', false) AND (df > 0 OR o > 0)), ('SHIFT-050', 'OPERATIONAL_CONTEXT', 'REVIEW', v IS NULL AND sm > 0),
        ('CONFLICT-001', 'PIPELINE', 'ACCEPT', (p > 0 OR m > 0 OR df > 0) AND (hp AND p = 0 OR hm AND m = 0 OR hd AND d = 0))]) AS r FROM x),
    z AS (SELECT "case", r[1] AS rule, r[2] AS scope, r[3] AS disposition, CASE r[3] WHEN 'ACCEPT' THEN 0 WHEN 'NOT_ASSESSED' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END AS s FROM y WHERE r[4])
"""


@register("rules_fired", f'WITH {_RULES_SQL} SELECT "case", rule, scope, disposition FROM z')
def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rule_outcomes(*_cases(spark, sf_dir))


@register("scope_decisions", f'WITH {_RULES_SQL} SELECT "case", scope, arg_max(disposition, (s, rule)) AS disposition, arg_max(rule, (s, rule)) AS rule, count(*) AS fired FROM z GROUP BY ALL')
def scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.scope_decisions(fusion.rule_outcomes(*_cases(spark, sf_dir)))


@register("overall_decision", f'WITH {_RULES_SQL}, t AS (SELECT "case", scope, arg_max(disposition, (s, rule)) AS d, arg_max(rule, (s, rule)) AS r, max(s) AS s FROM z GROUP BY ALL) SELECT "case", arg_max(d, (s, scope)) AS disposition, arg_max(scope, (s, scope)) AS scope, arg_max(r, (s, scope)) AS rule FROM t GROUP BY 1')
def overall_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.overall(fusion.scope_decisions(fusion.rule_outcomes(*_cases(spark, sf_dir))))


@register(
    "report_summary",
    """
    WITH g AS (SELECT CASE WHEN count(*) >= 20 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1), s AS (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity, unnest([0, 1, 2, 3, 4]) AS rank)
    SELECT s.severity, rank, count(g.severity) AS n, count(*) FILTER (g.severity = 'HIGH') AS quarantine, count(*) FILTER (g.severity IN ('LOW', 'MEDIUM')) AS review, 0::BIGINT AS accept FROM s LEFT JOIN g USING (severity) GROUP BY ALL
    """,
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans.dataset_queries import exact_dup_groups

    return fusion.report_summary(exact_dup_groups(spark, sf_dir))


@register("confidence_by_basis", f"""WITH {_CASES_SQL} SELECT "case", basis, count(*) AS n, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high, round(median(confidence), 6) AS median FROM h WHERE supporting GROUP BY ALL""")
def confidence_by_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.confidence_by_basis(_cases(spark, sf_dir)[1])


@register(
    "severity_counts",
    f"""WITH {_CASES_SQL}, s AS (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity, unnest(range(5)) AS rank)
    SELECT c."case", s.severity, count(*) FILTER (h.supporting) AS supporting, count(*) FILTER (NOT h.supporting) AS context FROM (SELECT DISTINCT "case" FROM h) c CROSS JOIN s LEFT JOIN h ON h."case" = c."case" AND h.rank = s.rank GROUP BY ALL""",
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.severity_counts(_cases(spark, sf_dir)[1])


@register(
    "decision_lineage",
    f"""
    WITH {_RULES_SQL}, k AS (SELECT c_nationkey::VARCHAR AS "case", 'F-' || c_custkey AS fid FROM customer WHERE c_custkey % 40 = c_nationkey),
    w AS (SELECT f."case", 'F-' || f.id AS fid, 'E-' || substr(sha256(f."case" || '|F-' || f.id), 1, 12) AS eid, ['DATASET', 'DATASET', 'DATASET', 'OPERATIONAL_CONTEXT', 'MODEL', 'MODEL', 'PROVENANCE', 'PROVENANCE', 'DATASET'][a + 1] AS scope,
                 cov <> 0 AND s >= 6 AND (b = 0 OR confidence >= 0.3) AS supporting FROM f)
    SELECT "case", fid AS child, eid AS parent FROM w UNION SELECT w."case", eid, rule FROM w JOIN z ON z."case" = w."case" AND z.scope = w.scope WHERE supporting
    UNION SELECT "case", rule, scope FROM z UNION SELECT "case", scope, 'DECISION' FROM z
    """,
)
def decision_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, rows, moved = _cases(spark, sf_dir)
    fired = fusion.rule_outcomes(cases, rows, moved)
    scopes = fusion.scope_decisions(fired)
    return fusion.lineage(rows, fired, scopes, fusion.overall(scopes))

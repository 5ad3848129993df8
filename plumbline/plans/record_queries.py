"""Queries of record checks, trust decisions, model files, populations and evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.functions.canonical import canonical
from plumbline.operators import evaluation, model_files, models, populations, records
from plumbline.plans.assurance_queries import _STATS_SQL, tensors
from plumbline.plans.dataset_queries import _QUALITY_SQL, _quality_scores, disposition_sql, table
from plumbline.plans.registry import register

# ---------------------------------------------------------------- records and keys


@register(
    "record_checks",
    """
    WITH r AS (SELECT *, coalesce(lang, '') AS pre, coalesce(source, '') AS inf, coalesce(n_chars::VARCHAR, '') AS outp FROM documents),
    c AS (SELECT doc_id, 'schema_supported' AS "check", doc_id % 31 <> 0 AS ok, 'UNSUPPORTED_SCHEMA' AS code FROM r
          UNION ALL SELECT doc_id, 'record_id_matches_content', doc_id % 13 <> 0, 'SELF_INCONSISTENT_RECORD' FROM r
          UNION ALL SELECT doc_id, 'preprocessing_digest_self_consistent', doc_id % 17 <> 0, 'CONFIGURATION_MISMATCH' FROM r
          UNION ALL SELECT doc_id, 'inference_config_digest_self_consistent', doc_id % 19 <> 0, 'CONFIGURATION_MISMATCH' FROM r
          UNION ALL SELECT doc_id, 'output_digest_self_consistent', doc_id % 23 <> 0, 'OUTPUT_MISMATCH' FROM r
          UNION ALL SELECT doc_id, 'required_fields_present', doc_id % 29 <> 0 AND doc_id % 37 <> 0 AND trim(inf) <> '', 'MISSING_FIELD' FROM r)
    SELECT doc_id, "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS outcome, CASE WHEN NOT ok THEN code END AS failure FROM c
    UNION ALL SELECT doc_id, unnest(['timestamp_present', 'nonce_present']), 'OBSERVED', NULL FROM r
    """,
)
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, in which some digests, schemas and fields are not what they should be."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    altered = lambda c, k: fi.sha256(F.concat(text(c), F.when(i % k == 0, "!").otherwise("")))
    rows = docs.select(
        "doc_id", F.when(i % 31 == 0, "9.9").otherwise("1.0").alias("schema_version"), altered("text", 13).alias("record_id"), fi.sha256(text("text")).alias("content_digest"),
        altered("lang", 17).alias("preprocessing_digest"), text("lang").alias("preprocessing_content"), altered("source", 19).alias("inference_digest"), text("source").alias("inference_content"),
        F.when(i % 23 != 0, fi.sha256(text("n_chars"))).alias("output_digest"), text("n_chars").alias("output_content"),
        F.when(i % 29 == 0, " ").otherwise(i.cast("string")).alias("nonce"), F.when(i % 37 != 0, "2024-01-01").alias("timestamp"), text("source").alias("log_id"),
    )
    return records.record_checks(rows, "doc_id")


@register(
    "key_authority",
    """
    WITH r AS (SELECT o_orderkey AS record, CASE WHEN o_custkey % 6 <> 5 THEN o_custkey % 6 END AS k, o_orderkey % 10 <> 4 AS own, CASE WHEN o_orderkey % 41 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ts FROM orders),
    x AS (SELECT *, k IS NOT NULL AND own AS able, k IS NOT NULL AND own AND k <= 3 AS found FROM r)
    SELECT record, 'key_known' AS "check", CASE WHEN NOT able THEN 'NOT_APPLICABLE' WHEN found THEN 'PASS' ELSE 'FAIL' END AS outcome, CASE WHEN k IS NOT NULL AND NOT found THEN 'UNKNOWN_KEY' END AS failure FROM x
    UNION ALL SELECT record, 'key_trusted', CASE WHEN NOT able THEN 'NOT_APPLICABLE' WHEN found AND k IN (0, 2) THEN 'PASS' ELSE 'FAIL' END, CASE WHEN able AND found AND k = 1 THEN 'REVOKED_KEY' WHEN able AND NOT (found AND k IN (0, 2)) THEN 'UNKNOWN_KEY' END FROM x
    UNION ALL SELECT record, 'signed_before_revocation', 'OBSERVED', NULL FROM x WHERE found AND k = 1
    UNION ALL SELECT record, 'key_within_validity_window', CASE WHEN k <> 0 THEN 'NOT_APPLICABLE' WHEN ts = 'soon' OR ts < '1993-01-01' OR ts > '1997-01-01' THEN 'FAIL' ELSE 'PASS' END,
                     CASE WHEN k <> 0 THEN NULL WHEN ts = 'soon' THEN 'MALFORMED_RECORD' WHEN ts < '1993-01-01' THEN 'KEY_NOT_YET_VALID' WHEN ts > '1997-01-01' THEN 'KEY_EXPIRED' END FROM x WHERE found
    UNION ALL SELECT record, 'key_purpose_permitted', CASE WHEN k = 2 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN k = 2 THEN 'KEY_PURPOSE_MISMATCH' END FROM x WHERE found
    """,
)
def key_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signed records: some name no key, some another than signed them, some have no readable time."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record"), F.when(F.col("o_custkey") % 6 != 5, (F.col("o_custkey") % 6).cast("string")).alias("key_id"), (F.col("o_orderkey") % 10 != 4).alias("key_id_consistent"),
        F.when(F.col("o_orderkey") % 41 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("timestamp"),
    )
    store = [("0", "TRUSTED", "1993-01-01", "1997-01-01", "inference", None), ("1", "REVOKED", None, None, "any", "1996-01-01"), ("2", "TRUSTED", None, None, "report", None), ("3", "UNKNOWN", None, None, "inference", None)]
    return records.authority_checks(rows, spark.createDataFrame(store, "key_id string, status string, valid_from string, valid_until string, purpose string, revoked_at string"), "record")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as keys: each is trusted, some by a wrong name; some are revoked, a few without a reason; some are no longer trusted."""
    s = F.col("s_suppkey")
    rows, none = table(spark, sf_dir, "supplier"), F.lit(None).cast("string")
    name = F.concat(F.lit("k"), s)

    def part(where: str, operation: str, turn: int, key: F.Column, reason: F.Column) -> DataFrame:
        return rows.where(where).select((s * 10 + turn).alias("seq"), F.lit(operation).alias("operation"), key.alias("key_id"), name.alias("fingerprint"), reason.alias("reason"), F.lit(f"2024-01-0{turn + 1}").alias("at"), none.alias("valid_from"), none.alias("valid_until"), F.lit("inference").alias("purpose"))

    out = part("true", "trust", 0, F.when(s % 7 == 2, "bad").when(s % 2 == 0, name), none)
    out = out.union(part("s_suppkey % 3 = 0", "revoke", 1, name, F.when(s % 9 == 0, " ").otherwise("lost")))
    return out.union(part("s_suppkey % 4 = 1", "untrust", 2, name, F.lit("doubt")))


_TRUST_SQL = "s AS (SELECT s_suppkey AS s, s_suppkey % 7 <> 2 AS there, s_suppkey % 3 = 0 AND s_suppkey % 9 <> 0 AS revoked, s_suppkey % 4 = 1 AS doubted FROM supplier)"


@register(
    "trust_store",
    f"""WITH {_TRUST_SQL} SELECT 'k' || s AS key_id, CASE WHEN doubted THEN 'UNKNOWN' WHEN revoked THEN 'REVOKED' ELSE 'TRUSTED' END AS status, 'inference' AS purpose,
        CASE WHEN revoked AND NOT doubted THEN '2024-01-02' END AS revoked_at, CASE WHEN doubted THEN 'doubt' WHEN revoked THEN 'lost' END AS reason FROM s WHERE there""",
)
def trust_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.apply_decisions(_decisions(spark, sf_dir))[0].select("key_id", "status", "purpose", "revoked_at", "reason")


@register(
    "trust_refusals",
    f"""WITH {_TRUST_SQL} SELECT s * 10 AS seq, 'trust' AS operation, 'bad' AS key_id, 'KEY_ID_MISMATCH' AS refused FROM s WHERE NOT there
        UNION ALL SELECT s * 10 + 1, 'revoke', 'k' || s, CASE WHEN there THEN 'NO_REASON' ELSE 'NOT_IN_STORE' END FROM s WHERE s % 3 = 0 AND (NOT there OR s % 9 = 0)
        UNION ALL SELECT s * 10 + 2, 'untrust', 'k' || s, 'NOT_IN_STORE' FROM s WHERE doubted AND NOT there""",
)
def trust_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.apply_decisions(_decisions(spark, sf_dir))[1]


# ---------------------------------------------------------------- model files


@register(
    "op_type_rollup",
    f"""WITH {_STATS_SQL} SELECT coalesce(peer_group, 'ALL') AS op_type, count(*) AS tensors, sum(n)::BIGINT AS parameters, 0::BIGINT AS non_finite, round(avg(l2), 6) AS mean_l2, round(max(max_abs), 6) AS max_abs,
        round(avg(sparsity), 6) AS mean_sparsity, round(median(l2), 6) AS median_l2, round(median(kurtosis), 6) AS median_kurtosis FROM s GROUP BY GROUPING SETS ((), (peer_group))""",
)
def op_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensors(spark, sf_dir)
    return model_files.roll_up(models.tensor_stats(rows).join(rows.select("name", F.col("peer_group").alias("op_type")), "name"))


@register(
    "non_finite_weights",
    f"""WITH t AS (SELECT label::BIGINT AS model, vec_id % 50 = 3 AS a, vec_id % 70 = 4 AS b FROM embeddings WHERE label IS NOT NULL),
        g AS (SELECT model, count(*) FILTER (a OR b) AS tensors, count(*) FILTER (a)::BIGINT AS nan, count(*) FILTER (b)::BIGINT AS inf FROM t GROUP BY 1)
        SELECT *, 'HIGH' AS severity, 1.0::DOUBLE AS confidence, {disposition_sql("'HIGH'", "1.0", "'DETERMINISTIC'")} FROM g WHERE tensors > 0""",
)
def non_finite_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tensors of a model for each label; some hold a value that is no number, some an infinite one."""
    rows = tensors(spark, sf_dir).withColumn("values", F.transform("values", lambda x: x.cast("double")))
    last = F.size("values") - 1
    marked = F.transform("values", lambda x, i: F.when((F.col("id") % 50 == 3) & (i == 0), float("nan")).when((F.col("id") % 70 == 4) & (i == last), float("inf")).otherwise(x))
    return model_files.non_finite_findings(rows.select(F.regexp_extract("name", r"layer(\d+)", 1).cast("long").alias("model"), "name", marked.alias("values")))


@register(
    "ood_guard",
    """
    WITH p AS (SELECT label::BIGINT AS model, vec_id % 3 AS predicted, (vec_id % 10) / 10.0::DOUBLE AS confidence FROM embeddings WHERE label IS NOT NULL),
    c AS (SELECT model, predicted, count(*) AS k, sum(confidence) AS c FROM p GROUP BY ALL)
    SELECT model, sum(k)::BIGINT AS n, round(sum(c) / sum(k), 4) AS mean_confidence, arg_max(predicted, (k, -predicted)) AS modal_class, round(max(k) / sum(k), 4) AS modal_share FROM c GROUP BY model
    """,
)
def ood_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    return model_files.ood_guard(rows.select(F.col("label").cast("long").alias("model"), (F.col("vec_id") % 3).alias("predicted"), ((F.col("vec_id") % 10) / 10.0).alias("confidence")))


@register(
    "behaviour_floors",
    """
    WITH m AS (SELECT n_nationkey AS model, CASE WHEN n_nationkey % 6 <> 5 THEN round(1 - n_nationkey * 0.012, 6)::DOUBLE END AS a, round(0.5 + n_nationkey * 0.02, 6)::DOUBLE AS c FROM nation)
    SELECT model, 'behavioural_divergence' AS kind, round(1 - a, 9) AS score, CASE WHEN 1 - a > 0.2 THEN 'HIGH' WHEN 1 - a > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM m WHERE a < 0.98
    UNION ALL SELECT model, 'metamorphic_instability', round(1 - c, 9), 'MEDIUM' FROM m WHERE c < 0.7
    """,
)
def behaviour_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("model"), F.when(k % 6 != 5, F.round(1 - k * 0.012, 6)).alias("agreement"), F.round(0.5 + k * 0.02, 6).alias("consistency"))
    return model_files.behaviour_findings(rows)


@register(
    "model_manifests",
    """
    WITH m AS (SELECT n_nationkey AS k, n_nationkey % 5 <> 4 AS sound, n_nationkey % 7 <> 3 AS there, n_nationkey % 11 = 2 AS broken FROM nation)
    SELECT k AS model, CASE WHEN sound AND there AND NOT broken THEN k % 3 <> 1 END AS file_matches, CASE WHEN sound AND there AND NOT broken AND k % 4 <> 0 THEN true END AS graph_matches,
           CASE WHEN sound AND there AND NOT broken THEN k % 6 <> 1 END AS parameters_matches,
           CASE WHEN NOT sound THEN 'REFUSED' WHEN NOT there THEN 'MISSING_ARTIFACT' WHEN broken THEN 'UNREADABLE' WHEN k % 3 = 1 OR k % 6 = 1 THEN 'MODIFIED' ELSE 'VERIFIED' END AS status FROM m
    """,
)
def model_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as models: some manifests do not recompute, some files are absent, unreadable, rebuilt or of other weights."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    rows = table(spark, sf_dir, "nation")
    recorded = rows.select(k.alias("model"), name.alias("file"), F.when(k % 4 != 0, name).alias("graph"), name.alias("parameters"), name.alias("own"), F.when(k % 5 != 4, name).otherwise("x").alias("recomputed"))
    broken = k % 11 == 2
    found = rows.where("n_nationkey % 7 != 3").select(
        k.alias("model"), F.when(~broken, F.when(k % 3 == 1, "x").otherwise(name)).alias("file"), F.when(~broken, name).alias("graph"), F.when(~broken, F.when(k % 6 == 1, "x").otherwise(name)).alias("parameters"), F.when(broken, "cannot be read").alias("error")
    )
    return model_files.verify_manifests(recorded, found)


# ---------------------------------------------------------------- populations


@register(
    "dimension_mismatches",
    """
    WITH d AS (SELECT doc_id AS id, n_chars::BIGINT + (doc_id % 14 = 0)::INT AS declared_width, CASE WHEN doc_id % 18 <> 0 THEN 1 END AS declared_height, length(text) AS width, 1 + (doc_id % 15 = 0)::INT AS height FROM documents WHERE text IS NOT NULL AND doc_id % 16 <> 0)
    SELECT * FROM d WHERE declared_width <> width AND declared_height IS NOT NULL OR declared_height <> height
    """,
)
def dimension_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents as declared and actual widths."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(i.alias("id"), "text", (F.col("n_chars").cast("long") + (i % 14 == 0).cast("int")).alias("declared_width"), F.when(i % 18 != 0, 1).alias("declared_height"))
    facts = docs.select("id", (F.col("text").isNotNull() & (F.col("id") % 16 != 0)).alias("readable"), F.char_length("text").cast("long").alias("width"), (1 + (F.col("id") % 15 == 0).cast("int")).alias("height"))
    whole = docs.where("declared_width is not null and declared_height is not null").drop("text")
    return populations.dimension_mismatches(whole, facts)


@register(
    "object_crops",
    """
    WITH b AS (SELECT l_orderkey AS id, l_linenumber AS annotation, l_returnflag AS label, l_quantity::DOUBLE - 10 AS x1, l_linenumber * 3.5::DOUBLE AS y1, l_quantity::DOUBLE + l_linenumber * 4.5 AS x2, l_linenumber * 3.5::DOUBLE + l_quantity::DOUBLE AS y2 FROM lineitem),
    c AS (SELECT id, annotation, label, greatest(0, round_even(x1, 0)::INT) AS x1, greatest(0, round_even(y1, 0)::INT) AS y1, least(60, round_even(x2, 0)::INT) AS x2, least(50, round_even(y2, 0)::INT) AS y2 FROM b)
    SELECT * FROM c WHERE x2 - x1 >= 16 AND y2 - y1 >= 16
    """,
)
def object_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes in images of 60 by 50 pixels."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("annotation"), F.col("l_returnflag").alias("label"), F.array(q - 10, n * 3.5, q + n * 4.5, n * 3.5 + q).alias("box"), F.lit(60).alias("width"), F.lit(50).alias("height"))
    return populations.object_crops(rows)


@register(
    "population_counts",
    """
    WITH d AS (SELECT lang, source FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)
    SELECT 'all' AS kind, NULL AS value, count(*) AS n FROM d UNION ALL SELECT 'class', lang, count(*) FROM d GROUP BY lang UNION ALL SELECT 'contributor', source, count(*) FROM d GROUP BY source
    """,
)
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("valid"), F.col("lang").alias("label"), F.col("source").alias("contributor"))
    return populations.build_population(docs, docs.where("id % 2 = 0").select("id"))


@register(
    "population_identity",
    """
    WITH d AS (SELECT source AS population, sha256(coalesce(text, '')) AS d FROM documents),
    s AS (SELECT population, concat_ws('|', count(*)::VARCHAR, {words}) AS samples FROM d GROUP BY 1)
    SELECT population, sha256(samples || '|descriptor|1.0|64') AS identity FROM s
    """.replace("{words}", ", ".join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))),
)
def population_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("population"), fi.sha256(F.coalesce("text", F.lit(""))).alias("digest"))
    return populations.population_digest(rows, "descriptor", "1.0", 64)


@register(
    "outlier_severity",
    """
    WITH u AS (SELECT vec_id AS id, vec_id % 4 AS exceeded, (vec_id % 1000) / 1000.0::DOUBLE AS p FROM embeddings)
    SELECT id, CASE WHEN exceeded = 3 AND p <= 0.005 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 1 - p AS score FROM u WHERE exceeded > 0
    """,
)
def outlier_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return populations.outlier_severity(table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 4).alias("exceeded"), ((i % 1000) / 1000.0).alias("min_p")), 3, True)


@register(
    "qualified_labels",
    "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'LOW' WHEN vec_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN vec_id % 5 = 0 THEN 'ood' END AS qualified_by FROM embeddings WHERE vec_id % 3 = 0",
)
def qualified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return populations.qualify_by_outliers(rows.where("id % 3 = 0").withColumn("severity", F.when(F.col("id") % 2 == 0, "HIGH").otherwise("MEDIUM")), rows.where("id % 5 = 0"))


@register(
    "clusters_not_reported",
    """
    WITH c AS (SELECT doc_id // 3 AS key, doc_id AS id FROM documents), g AS (SELECT doc_id // 3 AS key, doc_id AS id FROM documents WHERE (doc_id // 3) % 4 = 0 OR (doc_id // 3) % 4 = 1 AND doc_id % 3 <> 1),
    x AS (SELECT key, list(id ORDER BY id) AS ids FROM c GROUP BY 1), y AS (SELECT list(id ORDER BY id) AS ids FROM g GROUP BY key)
    SELECT key, len(ids)::BIGINT AS n FROM x WHERE ids NOT IN (SELECT ids FROM y)
    """,
)
def clusters_not_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threes of documents as clusters; groups that are equal to every fourth one, and ones that lack a member."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("key"), F.col("doc_id").alias("id"))
    return populations.suppress_reported(rows, rows.where("key % 4 = 0 or key % 4 = 1 and id % 3 != 1"))


@register(
    "capability_statement",
    """
    WITH b AS (SELECT unnest(['conflicting_evidence', 'coverage_aware_assurance', 'cross_module_lineage', 'distribution_shift', 'evidence_dependency', 'evidence_fusion', 'operational_drift', 'policy_disposition']) AS capability,
                      unnest(['SUPPORTED', 'SUPPORTED', 'SUPPORTED', 'PARTIAL', 'PARTIAL', 'SUPPORTED', 'PARTIAL', 'SUPPORTED']) AS build,
                      unnest([NULL, NULL, NULL, 'bounded by the integrity of the reference population', 'independence is decided by a table, not measured', NULL, 'a declared change is never verified', NULL]) AS bound),
    r AS (SELECT CASE event_type WHEN 'click' THEN 'evidence_fusion' WHEN 'view' THEN 'distribution_shift' ELSE 'other' END AS capability, 'PARTIAL' AS coverage FROM events GROUP BY 1)
    SELECT b.capability, build, coalesce(coverage, 'NOT_ASSESSED') AS coverage, CASE WHEN coverage IS NULL THEN 'this run did not exercise the capability' ELSE bound END AS reason FROM b LEFT JOIN r USING (capability)
    """,
)
def capability_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "evidence_fusion").when(F.col("event_type") == "view", "distribution_shift").otherwise("other")
    return populations.capability_statement(table(spark, sf_dir, "events").select(name.alias("capability")).distinct().withColumn("coverage", F.lit("PARTIAL")))


# ---------------------------------------------------------------- evaluation


@register(
    "scenario_metrics",
    """
    WITH s AS (SELECT source AS scenario, doc_id AS id, toxic = 1 AS tox, quality = 0 AS junk FROM documents JOIN labels USING (doc_id)),
    a AS (SELECT scenario, id, 'toxic' AS attack_class, tox AS actual, id % 5 = 0 OR tox AND id % 3 <> 0 AS predicted, tox OR junk AS dirty FROM s UNION ALL SELECT scenario, id, 'junk', junk, junk AND id % 4 <> 1 OR id % 50 = 7, tox OR junk FROM s),
    n AS (SELECT scenario, count(*) FILTER (NOT (tox OR junk)) AS clean FROM s GROUP BY 1)
    SELECT scenario, attack_class, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn,
           round(CASE WHEN count(*) FILTER (predicted) > 0 THEN count(*) FILTER (actual AND predicted) / count(*) FILTER (predicted) END, 9) AS precision, round(CASE WHEN count(*) FILTER (actual) > 0 THEN count(*) FILTER (actual AND predicted) / count(*) FILTER (actual) END, 9) AS recall,
           round(CASE WHEN any_value(clean) > 0 THEN count(*) FILTER (predicted AND NOT dirty) / any_value(clean) END, 9) AS clean_fpr
    FROM a JOIN n USING (scenario) GROUP BY scenario, attack_class HAVING count(*) FILTER (actual OR predicted) > 0
    """,
)
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as scenarios, toxic and poor documents as what an attack did, and flags that are partly wrong."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("scenario"), F.col("doc_id").alias("id")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("tox"), (F.col("quality") == 0).alias("junk")), "id")

    def part(where: str, name: str) -> DataFrame:
        return rows.where(where).select("scenario", "id", F.lit(name).alias("attack_class"))

    truth = part("tox", "toxic").union(part("junk", "junk"))
    flagged = part("id % 5 = 0 or tox and id % 3 != 0", "toxic").union(part("junk and id % 4 != 1 or id % 50 = 7", "junk"))
    return evaluation.class_metrics(rows.select("scenario", "id"), truth, flagged)


@register(
    "pooled_calibration",
    f"""
    WITH {_QUALITY_SQL}, d AS (SELECT s.*, lang AS attack_class FROM s JOIN documents USING (doc_id)),
    e AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS bin, unnest([0.0, 0.25, 0.5, 0.7, 0.85, 0.95])::DOUBLE AS lower, unnest([0.25, 0.5, 0.7, 0.85, 0.95, 1.0])::DOUBLE AS upper),
    g AS (SELECT * FROM (SELECT DISTINCT attack_class FROM d), e),
    c AS (SELECT g.attack_class, g.bin, lower, upper, count(score) AS n, coalesce(sum(truth), 0)::BIGINT AS hits FROM g LEFT JOIN d ON d.attack_class = g.attack_class AND score >= lower AND (score < upper OR upper = 1.0) GROUP BY ALL),
    w AS (SELECT *, 1.6448536269514722::DOUBLE AS z, CASE WHEN n > 0 THEN hits / n END AS p FROM c)
    SELECT attack_class, bin, lower, upper, n, hits, round(p, 9) AS precision,
           round(CASE WHEN n > 0 THEN greatest(0.0, least(1.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) ELSE 0.0 END, 9) AS wilson FROM w
    """,
)
def pooled_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pooled_calibration(_quality_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("attack_class")), "doc_id"))


# ---------------------------------------------------------------- canonical forms


@register(
    "canonical_digests",
    """
    WITH e AS (
        SELECT event_id, event_id % 10 = 3 AS as_float, event_id % 17 = 4 AS twice, CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
               '{"cents":' || CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) || ',"id":' || event_id || ',"who":{"kind":"' || event_type || '","user":' || user_id || '}}' AS text
        FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL
    )
    SELECT event_id, CASE WHEN as_float THEN 'FLOAT' WHEN twice THEN 'REPEATED_KEY' END AS fault, CASE WHEN NOT as_float AND NOT twice THEN sha256(text) END AS digest FROM e
    """,
)
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON in another order and with spaces: digests of their canonical texts, or why there is none."""
    e = table(spark, sf_dir, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL")
    cents = F.bround(F.col("value") * 100).cast("long").cast("string")
    amount = F.when(F.col("event_id") % 10 == 3, F.lit("1.5")).otherwise(cents)
    again = F.when(F.col("event_id") % 17 == 4, F.lit(', "cents": 1')).otherwise(F.lit(""))
    raw = F.concat(F.lit('{ "who": {"user": '), F.col("user_id"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}, "id": '), F.col("event_id"), F.lit(', "cents": '), amount, again, F.lit(" }"))
    rows = e.select("event_id", canonical(raw).alias("c"))
    return rows.select("event_id", "c.fault", fi.sha256(F.col("c.text")).alias("digest"))

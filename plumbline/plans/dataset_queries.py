"""Queries of dataset forensics: duplicates, labels, outliers, contributors, metadata; with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.operators import contributors, duplicates, integrity, neighbours
from plumbline.operators.outliers import combined_outliers
from plumbline.plans.registry import register
from plumbline.sources.shared import written

#: Rows of a partition of lines and orders, about.
PART_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finding_sql(method: str, attack_class: str, asset: str, digest: str) -> str:
    return f"""'F-' || substr(sha256('{{"asset":"' || {asset} || '","attack_class":"{attack_class}","discriminator":["' || {digest} || '"],"method":"{method}","version":"1.0"}}'), 1, 12)"""


def severity_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 20 THEN 'HIGH' WHEN {n} >= 5 THEN 'MEDIUM' ELSE 'LOW' END"


def disposition_sql(severity: str, confidence: str, basis: str) -> str:
    rank = f"list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], {severity})"
    case = f"WHEN {rank} >= 4 AND {confidence} >= 0.85 AND {basis} <> 'HEURISTIC_UNCALIBRATED' THEN '{{}}' WHEN {rank} >= 4 THEN '{{}}' WHEN {rank} >= 2 AND {confidence} >= 0.3 THEN '{{}}' ELSE '{{}}'"
    return "CASE " + case.format("QUARANTINE", "REVIEW", "REVIEW", "ACCEPT") + " END AS disposition, CASE " + case.format("D-100", "D-110", "D-200", "D-900") + " END AS disposition_rule"


@register(
    "exact_dup_groups",
    f"""
    WITH g AS (SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS representative,
                      CASE WHEN count(DISTINCT source) = 1 AND count(source) = count(*) THEN min(source) END AS contributor
               FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT digest, n, representative, contributor, {severity_sql("n")} AS severity, {finding_sql("exact_duplicate", "duplicate_flood", "representative", "digest")} AS finding_id,
           {disposition_sql(severity_sql("n"), "1.0", "'DETERMINISTIC'")} FROM g
    """,
)
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "source")


@register(
    "content_dup_groups",
    f"""
    WITH o AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, '* ' || text FROM documents WHERE doc_id % 17 = 0),
    d AS (SELECT doc_id, sha256(text) AS raw, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS c FROM o WHERE text IS NOT NULL),
    g AS (SELECT sha256(c) AS digest, count(*) AS n, count(DISTINCT raw) AS forms, min(doc_id) AS representative FROM d WHERE c <> '' GROUP BY 1 HAVING count(DISTINCT raw) > 1)
    SELECT digest, n, forms, representative, {severity_sql("n")} AS severity, {finding_sql("exact_duplicate_content", "duplicate_flood", "representative", "digest")} AS finding_id,
           {disposition_sql(severity_sql("n"), "1.0", "'DETERMINISTIC'")} FROM g
    """,
)
def content_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the documents and copies of some of them with a mark ahead, which have other bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    copies = docs.where("doc_id % 17 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("* "), F.col("text")).alias("text"))
    return duplicates.content_groups(docs.union(copies), "doc_id", F.col("text"), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""))


_TOKENS_SQL = r"""
    h AS (SELECT min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)),
    t AS (SELECT id, tok, count(*) AS k FROM (SELECT h.id, unnest(regexp_split_to_array(lower(d.text), '\s+')) AS tok FROM h JOIN documents d ON d.doc_id = h.id) WHERE tok <> '' GROUP BY ALL),
    b AS (SELECT id, i, sum(CASE WHEN (('0x' || substr(sha256(tok), 1 + 8 * (i // 32)::INT, 8))::BIGINT >> (i % 32)) & 1 = 1 THEN k ELSE -k END) > 0 AS bit FROM t, range(64) r(i) GROUP BY id, i),
    c AS (SELECT id, sum(CASE WHEN bit AND i < 32 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN bit AND i >= 32 THEN 1::BIGINT << (i - 32) ELSE 0 END)::BIGINT AS lo FROM b GROUP BY id),
    p AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS distance FROM c x JOIN c y ON x.id < y.id WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 8)
"""


@register("hamming_pairs", f"WITH {_TOKENS_SQL} SELECT a, b, distance::INT AS distance FROM p")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.hamming_pairs(duplicates.text_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", kept=False))


_CONFIRMED_SQL = f"""{_TOKENS_SQL},
    n AS (SELECT id, sqrt(sum(k * k)::DOUBLE) AS norm FROM t GROUP BY id),
    e AS (SELECT p.a, p.b, p.distance, sum(x.k * y.k) / (any_value(na.norm) * any_value(nb.norm)) AS cosine
          FROM p JOIN t x ON x.id = p.a JOIN t y ON y.id = p.b AND y.tok = x.tok JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b GROUP BY p.a, p.b, p.distance
          HAVING sum(x.k * y.k) / (any_value(na.norm) * any_value(nb.norm)) >= 0.9)
"""


@register("near_dup_confirmed", f"WITH {_CONFIRMED_SQL} SELECT a, b, distance::INT AS distance, round(cosine, 6) AS cosine FROM e")
def near_dup_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = duplicates.blocks_of_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.near_text_pairs(blocks).withColumn("cosine", F.round("cosine", 6))


@register(
    "near_dup_clusters",
    f"""
    WITH RECURSIVE {_CONFIRMED_SQL},
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, low) AS (SELECT a, a FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node WHERE r.low < u.b),
    m AS (SELECT node, min(low) AS component FROM r GROUP BY node),
    g AS (SELECT component, count(*) AS n FROM m GROUP BY component),
    s AS (SELECT m.component, count(*) AS edges, avg(distance) AS md, avg(cosine) AS mc FROM e JOIN m ON m.node = e.a GROUP BY m.component)
    SELECT component, n, edges, round(md, 6) AS mean_distance, round(mc, 6) AS mean_cosine,
           round(greatest(0.0, least(1.0, 0.5 * (1 - md / 8) + 0.5 * (mc - 0.9) / (1 - 0.9))), 6) AS score, {severity_sql("n")} AS severity, 0.55::DOUBLE AS confidence,
           {disposition_sql(severity_sql("n"), "0.55", "'HEURISTIC_UNCALIBRATED'")} FROM g JOIN s USING (component)
    """,
)
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = duplicates.blocks_of_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.near_clusters(duplicates.near_text_links(blocks))


def tail_sql(k: str, n: str, share: str) -> str:
    p = f"greatest(1e-6, least(1 - 1e-9, {share}))"
    return f"least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


@register(
    "contributor_rates",
    f"""
    WITH g AS (SELECT sha256(text) AS s FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
    f AS (SELECT source AS contributor, count(DISTINCT doc_id) AS n, count(DISTINCT CASE WHEN sha256(text) IN (SELECT s FROM g) THEN doc_id END) AS k FROM documents GROUP BY 1),
    l AS (SELECT *, CASE WHEN sum(n) OVER () - n > 0 THEN (sum(k) OVER () - k) / (sum(n) OVER () - n) ELSE 0.5 END AS share FROM f),
    p AS (SELECT *, {tail_sql("k", "n", "share")} AS p FROM l WHERE n >= 8 AND k >= 2),
    q AS (SELECT *, row_number() OVER (ORDER BY p, contributor) AS rn, count(*) OVER () AS m FROM p),
    z AS (SELECT *, least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q, CASE WHEN share > 0 THEN k / n / share ELSE 'inf'::DOUBLE END AS ratio FROM q)
    SELECT contributor, n, k, round(share, 9) AS share, round(p, 9) AS p, round(q, 9) AS q, round(ratio, 6) AS ratio, 'LOW' AS severity, round(least(1 - q, 1.0, 0.99), 9) AS confidence, q < 0.05 AS reported FROM z
    """,
)
def contributor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = docs.where("text is not null").select(F.col("doc_id").alias("id"), fi.sha256(F.col("text")).alias("digest"))
    copied = digests.groupBy("digest").count().where("count > 1").select("digest")
    flags = digests.join(copied, "digest", "left_semi").select("id", F.lit("duplicate_flood").alias("attack_class"))
    out = contributors.over_represented(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("contributor")), flags, 1.0, "LOW")
    return out.select("contributor", "n", "k", F.round("share", 9).alias("share"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), F.round("ratio", 6).alias("ratio"), "severity", F.round("confidence", 9).alias("confidence"), "reported")


def _quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each labelled document (how much of its text is repeated words) against the truth that its quality is 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("truth"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    # The words are taken apart once: within a transform of one element they are not inlined again.
    words = F.array(F.split(F.lower("text"), r"\s+"))
    score = F.get(F.transform(words, lambda w: 1 - F.size(F.array_distinct(w)) / F.size(w)), F.lit(0))
    scored = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.round(score, 6).alias("score"))
    return written(scored, "quality-scores").join(labels, "doc_id")


_QUALITY_SQL = r"s AS (SELECT round(1 - len(list_distinct(w)) / len(w), 6) AS score, (quality = 0)::INT AS truth, doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\s+') AS w FROM documents WHERE text IS NOT NULL) JOIN labels USING (doc_id))"


@register(
    "calibration_bins",
    f"""
    WITH {_QUALITY_SQL},
    e AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS bin, unnest([0.0, 0.25, 0.5, 0.7, 0.85, 0.95])::DOUBLE AS lower, unnest([0.25, 0.5, 0.7, 0.85, 0.95, 1.0])::DOUBLE AS upper),
    c AS (SELECT e.bin, lower, upper, count(score) AS n, coalesce(sum(truth), 0)::BIGINT AS hits FROM e LEFT JOIN s ON score >= lower AND (score < upper OR upper = 1.0) GROUP BY ALL),
    w AS (SELECT *, 1.6448536269514722::DOUBLE AS z, CASE WHEN n > 0 THEN hits / n END AS p FROM c)
    SELECT bin, lower, upper, n, hits, round(p, 9) AS precision,
           round(CASE WHEN n > 0 THEN greatest(0.0, least(1.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) ELSE 0.0 END, 9) AS wilson FROM w
    """,
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributors.calibration_table(_quality_scores(spark, sf_dir))


@register(
    "auroc_by_source",
    f"""
    WITH {_QUALITY_SQL}, d AS (SELECT s.*, source FROM s JOIN documents USING (doc_id)),
    k AS (SELECT source, score, count(*) AS k, sum(truth) AS pos FROM d GROUP BY ALL),
    a AS (SELECT *, pos * (coalesce(sum(k - pos) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k - pos) / 2) AS part FROM k)
    SELECT source, sum(k)::BIGINT AS n, sum(pos)::BIGINT AS positives, CASE WHEN sum(k) >= 4 AND sum(pos) > 0 AND sum(pos) < sum(k) THEN round(sum(part) / (sum(pos) * (sum(k) - sum(pos))), 9) END AS auroc FROM a GROUP BY source
    """,
)
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return contributors.auroc(rows, ["source"])


@register(
    "confusion_by_class",
    f"""
    WITH {_QUALITY_SQL}, r AS (SELECT lang AS attack_class, score >= 0.5 AS predicted, truth = 1 AS actual, toxic = 1 AS tolerated FROM s JOIN documents USING (doc_id) JOIN labels USING (doc_id)),
    c AS (SELECT attack_class, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual AND NOT tolerated) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (predicted) AS flagged,
                 count(*) FILTER (NOT actual AND NOT tolerated) AS cn, count(*) FILTER (NOT actual AND NOT tolerated AND predicted) AS cf, count(*) FILTER (NOT actual) AS neg FROM r GROUP BY 1)
    SELECT attack_class, tp, fp, fn, flagged, round(CASE WHEN flagged > 0 THEN tp / flagged END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall,
           round(CASE WHEN cn > 0 THEN cf / cn END, 9) AS clean_fpr, round(CASE WHEN neg > 0 THEN fp / neg END, 9) AS fpr FROM c
    """,
)
def confusion_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    actual, tolerated = F.col("truth") == 1, F.col("toxic") == 1
    return contributors.confusion(rows.select(F.col("lang").alias("attack_class"), (F.col("score") >= 0.5).alias("predicted"), actual.alias("actual"), tolerated.alias("tolerated"), (~actual & ~tolerated).alias("clean")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


_LABEL_SQL = """
    v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 8)),
    d AS (SELECT x.id, x.label, y.id AS o, y.label AS vote, list_cosine_similarity(x.v, y.v) AS c FROM v x JOIN v y ON x.id <> y.id),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, o) AS rn FROM d) WHERE rn <= 10),
    w AS (SELECT id, label, vote, sum(1 / (1 - c + 1e-6)) AS w FROM k GROUP BY ALL),
    t AS (SELECT id, label, 1 - coalesce(sum(w) FILTER (vote = label), 0) / sum(w) AS disagreement, arg_min(vote, (-w, vote)) AS suggested FROM w GROUP BY id, label),
    u AS (SELECT id, label, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM v),
    m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM u GROUP BY ALL) GROUP BY label),
    r AS (SELECT t.*, list_cosine_similarity(v.v, n.c) - list_cosine_similarity(v.v, o.c) AS margin FROM t JOIN v USING (id) JOIN m n ON n.label = suggested JOIN m o ON o.label = t.label)
"""


@register(
    "label_knn",
    f"""WITH {_LABEL_SQL} SELECT id, label, round(disagreement, 6) AS disagreement, suggested, round(margin, 6) AS margin,
        CASE WHEN disagreement >= 0.9 AND margin > 0 THEN 'HIGH' WHEN disagreement >= 0.8 OR disagreement >= 0.7 AND margin > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, disagreement >= 0.7 AS flagged FROM r""",
)
def label_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.label_consistency(_points(spark, sf_dir)).withColumn("disagreement", F.round("disagreement", 6)).withColumn("margin", F.round("margin", 6))


@register(
    "systematic_mislabel",
    f"""
    WITH {_LABEL_SQL}, x AS (SELECT source AS contributor, label, suggested, disagreement >= 0.7 AS flagged FROM r JOIN documents ON doc_id = id),
    n AS (SELECT contributor, count(*) AS n FROM x GROUP BY 1),
    p AS (SELECT contributor, label, suggested, count(*) AS k FROM x WHERE flagged AND label <> suggested GROUP BY ALL),
    y AS (SELECT p.*, n, sum(k) OVER (PARTITION BY label, suggested) - k AS ok, (SELECT sum(n) FROM n) - n AS o FROM p JOIN n USING (contributor)),
    z AS (SELECT *, CASE WHEN o > 0 THEN ok / o ELSE k / n * 0.5 END AS share FROM y WHERE n >= 10 AND k >= 2),
    t2 AS (SELECT *, {tail_sql("k", "n", "share")} AS p FROM z), q AS (SELECT *, row_number() OVER (ORDER BY p, contributor, label, suggested) AS rn, count(*) OVER () AS mm FROM t2)
    SELECT contributor, label, suggested, k, n, round(share, 9) AS share, round(p, 9) AS p, round(least(1.0, min(p * mm / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM q
    """,
)
def systematic_mislabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = neighbours.label_consistency(_points(spark, sf_dir)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("contributor")), "id")
    out = neighbours.systematic_pairs(written(units.select("contributor", "label", "suggested", "flagged"), "units"), least_pair=2)
    return out.select("contributor", "label", "suggested", "k", "n", F.round("share", 9).alias("share"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@register(
    "ood_knn",
    """
    WITH v AS (SELECT vec_id AS id, label < 8 AS reference, embedding::DOUBLE[] AS v FROM embeddings),
    r AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM v WHERE reference),
    a AS (SELECT q.id, f.fold AS f, list_distance(q.v, p.v) AS d, p.id AS o FROM (SELECT DISTINCT fold FROM r) f JOIN r p ON p.fold <> f.fold JOIN (SELECT id, v, fold FROM r UNION ALL SELECT id, v, NULL FROM v WHERE NOT reference) q ON q.fold IS NULL OR q.fold = f.fold WHERE q.id <> p.id),
    k AS (SELECT id, f, avg(d) AS s FROM (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY d, o) AS rn FROM a) WHERE rn <= 5 GROUP BY ALL),
    s AS (SELECT k.id, reference, round(avg(s), 9) AS score FROM k JOIN v USING (id) GROUP BY ALL),
    t AS (SELECT list_sort(list(score) FILTER (reference)) AS l, count(*) FILTER (reference) AS n FROM s)
    SELECT s.id, s.reference, s.score, l[(ceil((n - 1) * 0.99) + 1)::INT] AS threshold, round(((SELECT count(*) FROM s x WHERE x.reference AND x.score >= s.score) + 1) / (n + 1), 9) AS p, s.score > l[(ceil((n - 1) * 0.99) + 1)::INT] AS flagged FROM s, t
    """,
)
def ood_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).where("label is not null").withColumn("reference", F.col("label") < 8)
    scores = written(neighbours.ood_neighbour_scores(points).withColumn("score", F.round("score", 9)), "ood")
    return neighbours.flag_by_reference(scores, 0.01).select("id", "reference", "score", "threshold", F.round("p", 9).alias("p"), "flagged")


@register("ood_subspace")
def ood_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).where("label is not null").withColumn("reference", F.col("label") < 8)
    return neighbours.ood_subspace_scores(points)


@register("ood_combined")
def ood_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).where("label is not null").withColumn("reference", F.col("label") < 8)
    return combined_outliers(points, True)


@register(
    "metadata_integrity",
    """
    WITH i AS (SELECT 'orphan_annotation' AS code, l_orderkey AS sample_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
               UNION ALL SELECT 'duplicate_id', l_orderkey FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn > 1
               UNION ALL SELECT 'invalid_bbox', l_orderkey FROM lineitem WHERE l_quantity <= 0
               UNION ALL SELECT 'unlabelled_sample', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
    SELECT code, sample_id, CASE WHEN code IN ('duplicate_id', 'invalid_bbox') THEN 'MEDIUM' ELSE 'LOW' END AS severity, 1::BIGINT AS n, 'REVIEW' AS disposition, 'D-200' AS disposition_rule FROM i
    """,
)
def metadata_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # Rows of one order are together in partitions of bounded size, narrow, for all checks: a task holds no more of a larger table.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((lines.count() + orders.count()) / PART_ROWS))
    placed, owners = lines.select("l_orderkey", "l_linenumber").repartition(parts, "l_orderkey"), orders.select("o_orderkey").repartition(parts, "o_orderkey")
    keys = placed.select("l_orderkey")
    again = placed.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select("l_orderkey", F.explode(F.sequence(F.lit(2), F.col("n"))))

    def issue(code: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.lit("").alias("locator"), F.col(key).alias("sample_id"))

    issues = issue("orphan_annotation", keys.join(owners.hint("merge"), keys.l_orderkey == owners.o_orderkey, "left_anti"), "l_orderkey")
    issues = issues.unionByName(issue("duplicate_id", again, "l_orderkey"))
    issues = issues.unionByName(issue("invalid_bbox", lines.where("l_quantity <= 0"), "l_orderkey"))
    issues = issues.unionByName(issue("unlabelled_sample", owners.join(keys.hint("merge"), keys.l_orderkey == owners.o_orderkey, "left_anti"), "o_orderkey"))
    return integrity.integrity_findings(issues)


@register(
    "manifest_verify",
    """
    WITH e AS (SELECT doc_id AS sample_id, sha256(coalesce(text, '')) AS expected FROM documents WHERE doc_id % 23 <> 0),
    a AS (SELECT doc_id AS sample_id, sha256(CASE WHEN doc_id % 19 = 0 THEN upper(coalesce(text, '')) || '!' ELSE coalesce(text, '') END) AS actual FROM documents WHERE doc_id % 29 <> 0)
    SELECT sample_id, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'added' ELSE 'modified' END AS status FROM e FULL JOIN a USING (sample_id) WHERE actual IS DISTINCT FROM expected
    """,
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents against a copy in which some are missing, added or changed."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    changed = docs.where("doc_id % 29 != 0").withColumn("text", F.when(F.col("doc_id") % 19 == 0, F.concat(F.upper(text), F.lit("!"))).otherwise(text))
    return integrity.verify_manifest(integrity.manifest(docs.where("doc_id % 23 != 0"), "doc_id", "source", F.col("text")), integrity.manifest(changed, "doc_id", "source", F.col("text")))


@register(
    "manifest_contributors",
    "SELECT coalesce(source, 'unknown') AS contributor, count(*) AS n, count(DISTINCT sha256(coalesce(text, ''))) AS distinct_digests, min(doc_id) AS first_sample FROM documents GROUP BY 1",
)
def manifest_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.contributor_summary(integrity.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", F.col("text")))


@register(
    "attribution",
    r"""
    WITH p AS (SELECT page_id AS sample_id, CASE WHEN page_id % 10 = 0 THEN 'side' || (page_id % 7) END AS side, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 3 = 0 THEN 'native' || (page_id % 5) END AS native, nullif(regexp_extract(url, '://([^/?#]+)', 1), '') AS pat FROM pages)
    SELECT sample_id, coalesce(side, nullif(native, ''), pat, 'unknown') AS contributor, CASE WHEN side IS NOT NULL THEN 'sidecar' WHEN nullif(native, '') IS NOT NULL THEN 'native' WHEN pat IS NOT NULL THEN 'path_pattern' ELSE 'unknown' END AS attribution_source FROM p
    """,
)
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("native", F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 3 == 0, F.concat(F.lit("native"), F.col("page_id") % 5)))
    sidecar = pages.where("page_id % 10 = 0").select(F.col("page_id").alias("sample_id"), F.concat(F.lit("side"), F.col("page_id") % 7).alias("contributor"))
    return integrity.attribute(pages, sidecar, "page_id", "url", "native", r"://([^/?#]+)")

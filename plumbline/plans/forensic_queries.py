"""Queries of canonical outputs, activations, permutation tests by column and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import activations, assessment, outputs, provenance, shift
from plumbline.plans.assurance_queries import _LOG_SQL, event_log, event_sides
from plumbline.plans.dataset_queries import table
from plumbline.plans.registry import register


@register(
    "output_digests",
    """
    WITH e AS (SELECT vec_id, [{'k': -round_even(embedding[i]::DOUBLE * 1000000, 0)::BIGINT, 'label': 'c' || i} FOR i IN range(1, 5)] AS s FROM embeddings),
    j AS (SELECT vec_id, '[' || array_to_string(list_transform(list_sort(s), lambda x: '{"label":"' || x.label || '","score":' || (-x.k)::BIGINT || '}'), ',') || ']' AS c FROM e)
    SELECT vec_id, sha256('{"kind":"classification","places":6,"value":' || c || '}') AS digest FROM j
    """,
)
def output_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four coordinates of each vector as a classification's scores."""
    scores = F.array(*(F.struct(F.lit(f"c{i}").alias("label"), F.get("embedding", F.lit(i - 1)).cast("double").alias("score")) for i in range(1, 5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", outputs.output_digest("classification", outputs.classification(scores)).alias("digest"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A battery of probes: all vectors, with their label as the predicted class."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    return rows.select(F.col("vec_id").alias("probe"), F.col("label").cast("long").alias("predicted"), F.col("embedding").alias("activation"))


@register("activation_spectral")
def activation_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations.spectral(_probes(spark, sf_dir))


@register("activation_clusters")
def activation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations.two_clusters(_probes(spark, sf_dir))


@register("psi_permutations")
def psi_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both numeric columns of events, against permutations that they share."""
    rows = event_sides(spark, sf_dir)
    return shift.psi_permutation_test(rows.select(F.lit("value").alias("column"), "id", "side", "value").union(rows.select(F.lit("user_id"), "id", "side", "user_id")), count=shift.permutation_budget(2))


@register(
    "prov_overall",
    f"""
    WITH {_LOG_SQL}, g AS (SELECT log_id, count(*) AS n, count(*) FILTER (link NOT IN ('GENESIS', 'LINKED') OR NOT in_sequence) AS broken FROM c GROUP BY 1)
    SELECT log_id, CASE WHEN broken > 0 THEN 'PROVENANCE COMPROMISED' ELSE 'PROVENANCE VERIFIED — PARTIAL COVERAGE' END AS overall FROM g
    """,
)
def prov_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each log without anchors: a break of the chain is a finding of the highest severity."""
    links = provenance.chain_links(event_log(spark, sf_dir))
    logs = provenance.chain_summary(links, None)
    open_classes = sum(v == "NOT_ASSESSED" for v in assessment.provenance_coverage(False, False, False, False).values())
    found = F.when(F.col("status") == "BROKEN", 1).otherwise(0)
    return assessment.provenance_overall(logs.select("log_id", "n", "status", "truncation", found.alias("quarantine"), F.lit(0).alias("severe"), found.alias("findings"), F.lit(open_classes).alias("unassessed")))

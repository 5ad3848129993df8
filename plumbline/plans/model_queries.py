"""Queries over stored models: files are written from the embeddings of each label and read again from their bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import model_files, models
from plumbline.plans.registry import register
from plumbline.sources import stored_models as stored
from plumbline.sources.shared import shared_folder, written

#: Rows of a tensor: vectors of one label with ids of one range.
ROWS = 50

_DIGESTS = f"""
    t AS (
        SELECT CAST(label AS BIGINT) AS model, vec_id // {ROWS} AS position, count(*) AS n, max(len(embedding)) AS d, list(embedding ORDER BY vec_id) AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY ALL
    ),
    v AS (SELECT model, position, n, d, list_reduce(list_transform(flatten(e), lambda x: CAST(CAST(round_even(CAST(x AS DOUBLE) * 1e6, 0) AS BIGINT) AS VARCHAR)), lambda a, b: a || ',' || b) AS units FROM t),
    digests AS (
        SELECT model, 'w' || lpad(CAST(position AS VARCHAR), 6, '0') AS name, 'float32' AS dtype, n || 'x' || d AS shape, CAST(n * d AS BIGINT) AS count,
               sha256('float32|' || n || 'x' || d || '|' || sha256(units)) AS digest, n || ',' || d AS sizes
        FROM v
    )
"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of at most ROWS embeddings each; a label is a model."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL AND embedding IS NOT NULL")
    groups = rows.groupBy(F.col("label").cast("long").alias("model"), F.floor(F.col("vec_id") / ROWS).cast("int").alias("position"))
    some = groups.agg(F.expr("flatten(transform(array_sort(collect_list(struct(vec_id, embedding))), x -> x.embedding))").alias("values"), F.count("*").cast("int").alias("rows"), F.max(F.size("embedding")).alias("columns"))
    return some.withColumn("name", F.concat(F.lit("w"), F.lpad(F.col("position").cast("string"), 6, "0")))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _measured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Digests of the tensors and of the models of a folder; model is the name of the file as a number."""
    files = stored.model_files(spark, path)
    parts = written(stored.read_structure(files), "model-parts")
    digests = written(stored.tensor_digests(stored.tensor_blocks(parts)), "model-tensors")
    number = F.regexp_extract("model", r"([0-9]+)\.onnx$", 1).cast("long")
    return digests.withColumn("model", number), stored.model_digests(files, parts, digests).withColumn("model", number)


@register(
    "stored_tensors",
    f"WITH {_DIGESTS} SELECT model, name, dtype, shape, count, digest FROM digests",
)
def stored_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of stored models, read from their files block by block."""
    path = _folder(spark, "models")
    stored.write_chain_models(tensors(spark, sf_dir), path)
    digests, _ = _measured(spark, path)
    return digests.select("model", "name", "dtype", F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), "count", "digest")


@register(
    "stored_models",
    f"""
    WITH {_DIGESTS}
    SELECT model, count(*) AS tensors, CAST(sum(count) AS BIGINT) AS parameter_count, sha256(string_agg(sha256(name || '|' || dtype || '|' || sizes || '|' || digest), ',' ORDER BY name)) AS parameters,
           CASE WHEN model % 2 = 0 THEN 'RESERIALISED' ELSE 'SAME_ARCHITECTURE_DIFFERENT_WEIGHTS' END AS relation, CASE WHEN model % 2 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
           false AS file_matches, true AS graph_matches, model % 2 = 0 AS parameters_matches, 'MODIFIED' AS status
    FROM digests GROUP BY model
    """,
)
def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored models against the same ones written again by another program, those of odd labels with one weight changed."""
    one, two = _folder(spark, "models"), _folder(spark, "models")
    rows = tensors(spark, sf_dir)
    stored.write_chain_models(rows, one)
    first = rows.groupBy("model").agg(F.min("position").alias("first"))
    changed = F.when((F.col("model") % 2 == 1) & (F.col("position") == F.col("first")), F.concat(F.array(F.col("values")[0] + F.lit(0.5).cast("float")), F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0)))))
    stored.write_chain_models(rows.join(first, "model").withColumn("values", F.coalesce(changed, F.col("values"))), two, "another program", raw=False)
    tensors_, reference = _measured(spark, one)
    _, supplied = _measured(spark, two)
    counts = tensors_.groupBy("model").agg(F.count("*").alias("tensors"))
    recorded = reference.select("model", "file", "graph", "parameters", F.lit("").alias("own"), F.lit("").alias("recomputed"))
    checked = model_files.verify_manifests(recorded, supplied.select("model", "file", "graph", "parameters", F.col("reason").alias("error")))
    out = reference.select("model", "parameter_count", "parameters").join(counts, "model").join(models.identity(supplied, reference), "model").join(checked, "model")
    return out.select("model", "tensors", "parameter_count", "parameters", "relation", "severity", "file_matches", "graph_matches", "parameters_matches", "status")

"""Metadata checks keep the rows of a task bounded."""

from pyspark.sql import functions as F

from plumbline.plans import dataset_queries


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    lines = spark.range(3000).select((F.col("id") % 900).alias("l_orderkey"), (F.col("id") % 2).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100, 1000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(dataset_queries, "PART_ROWS", 100, raising=False)
    found = dataset_queries.metadata_integrity(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 39), REPARTITION_BY_NUM" in plan
    got = {r.code: r.n for r in found.groupBy("code").agg(F.count("*").alias("n")).collect()}
    rows = [(r.l_orderkey, r.l_linenumber) for r in lines.collect()]
    assert got == {"orphan_annotation": sum(o < 100 for o, _ in rows), "duplicate_id": len(rows) - len(set(rows)), "unlabelled_sample": 100}

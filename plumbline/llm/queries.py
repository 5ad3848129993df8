"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import collocations, line_dedup, mixing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ann import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).drop("found").withColumnRenamed("id", "doc_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.embedding_dedup import near_components

    return near_components(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents")).drop("name")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.collocations import mine_collocations

    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.pii import fit, scan_pii

    docs = table(spark, sf_dir, "documents")
    return scan_pii(docs, model=fit(docs)).drop("found").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_search": op1_ann_search,
    "op2_html_main_text": op2_html_main_text,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_secret_scan": op4_secret_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_join": op7_ngram_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_personal_data": op13_personal_data,
}
SQL: dict[str, str] = {
    "op11_phrase_collocations": collocations.REPORT_SQL,
    "op10_line_dedup": line_dedup.REPORT_SQL,
    "op6_mix_sources": mixing.REPORT_SQL,
    "op3_warc_round_trip": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Streaming operators as queries: each runs to the end of its input and returns what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.assurance_queries import _LOG_SQL, _SHOWN_SQL, event_log, shown_records
from plumbline.plans.dataset_queries import table
from plumbline.plans.registry import register
from plumbline.sources.shared import shared_folder, written
from plumbline.streaming import monitors, replay, windows


def drained(stream: DataFrame) -> DataFrame:
    """Runs an append stream over all that its sources hold, into a Parquet table of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with replay.map_state(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """df as files that a stream reads."""
    path = written(df, name)
    folder = path.inputFiles()[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


@register("stream_chain", f"WITH {_LOG_SQL} SELECT log_id, sequence, digest, link, in_sequence, 'FIRST_OBSERVATION' AS verdict FROM c")
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("log_id", "line", "sequence", "digest", "previous")
    links = drained(monitors.verify_stream(as_stream(log, "log")))
    none = F.lit(None).cast("string")
    claims = drained(replay.replay_stream(as_stream(log.select(F.col("line").alias("seen"), "digest", none.alias("key_id"), none.alias("nonce"), "log_id", "sequence"), "claims")))
    answers = replay.replay_answers(claims).select(F.col("seen").alias("line"), "verdict")
    return links.join(answers, "line").select("log_id", "sequence", "digest", "link", "in_sequence", "verdict")


@register(
    "stream_replay",
    f"""
    WITH {_SHOWN_SQL}, w AS (SELECT *, lag(seen) OVER (PARTITION BY digest ORDER BY seen) AS d, CASE WHEN subject IS NOT NULL THEN lag(seen) OVER (PARTITION BY subject ORDER BY seen) END AS u, CASE WHEN key_id IS NOT NULL AND nonce IS NOT NULL THEN lag(seen) OVER (PARTITION BY key_id, nonce ORDER BY seen) END AS n,
        CASE WHEN log_id IS NOT NULL THEN lag(seen) OVER (PARTITION BY log_id, sequence ORDER BY seen) END AS q FROM s)
    SELECT seen, CASE WHEN d IS NOT NULL THEN 'REPLAY_EXACT' WHEN n IS NOT NULL THEN 'NONCE_REUSE' WHEN q IS NOT NULL THEN 'SEQUENCE_COLLISION' WHEN u IS NOT NULL THEN 'DUPLICATE_SUBJECT' ELSE 'FIRST_OBSERVATION' END AS verdict, coalesce(d, n, q, u) AS prior FROM w
    """,
)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some are shown again, as a stream."""
    shown = shown_records(spark, sf_dir)
    return replay.replay_answers(drained(replay.replay_stream(as_stream(shown, "shown"))))


@register(
    "stream_drift",
    """
    WITH r AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1), w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL),
    f AS (SELECT s.start, r.event_type, r.n / (SELECT sum(n) FROM r) AS p, coalesce(w.n, 0) AS c FROM (SELECT DISTINCT start FROM w) s CROSS JOIN r LEFT JOIN w ON w.start = s.start AND w.event_type = r.event_type),
    g AS (SELECT *, c / sum(c) OVER (PARTITION BY start) AS q, sum(c) OVER (PARTITION BY start) AS n FROM f)
    SELECT start, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 9) AS js, max(n)::BIGINT AS n FROM g WHERE start < (SELECT date_trunc('day', max(ts) - INTERVAL 2 HOUR) FROM events) GROUP BY start
    """,
)
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed, against the first week."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    reference = events.where("ts < timestamp'2024-01-08'").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return monitors.drift(drained(monitors.window_counts(as_stream(events, "events"))), reference)


def week_and_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of the first week, and all events."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return events.where("ts < timestamp'2024-01-08'"), events


@register(
    "stream_psi",
    """
    WITH r AS (SELECT value::DOUBLE AS v FROM events WHERE ts < TIMESTAMP '2024-01-08' AND value IS NOT NULL),
    e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM r),
    b AS (SELECT unnest(range(0, len(edges) + 1)) AS bin FROM e), p AS (SELECT len([x for x in edges if x < v]) AS bin, count(*) AS n FROM r, e GROUP BY 1),
    w AS (SELECT date_trunc('day', ts) AS start, len([x for x in edges if x < value::DOUBLE]) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT s.start, coalesce(p.n, 0) / (SELECT sum(n) FROM p) AS p, coalesce(w.n, 0) / sum(coalesce(w.n, 0)) OVER (PARTITION BY s.start) AS q, coalesce(w.n, 0) AS c,
               (SELECT sum(n) FROM p) AS n_r, sum(coalesce(w.n, 0)) OVER (PARTITION BY s.start) AS n
          FROM (SELECT DISTINCT start FROM w) s CROSS JOIN b LEFT JOIN p ON p.bin = b.bin LEFT JOIN w ON w.start = s.start AND w.bin = b.bin),
    g AS (SELECT *, greatest(p, 1 / (2 * n_r)) AS p1, greatest(q, 1 / (2 * n)) AS q1 FROM f),
    h AS (SELECT start, sum((q1 - p1) * ln(q1 / p1)) AS psi, max(n)::BIGINT AS n,
               sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js FROM g GROUP BY start)
    SELECT start, round(psi, 9) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS band, round(js, 9) AS js, n FROM h
    WHERE start < (SELECT date_trunc('day', max(ts) - INTERVAL 2 HOUR) FROM events)
    """,
)
def stream_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each closed day in the bins of the first week."""
    week, events = week_and_events(spark, sf_dir)
    reference = written(windows.reference_bins(week, "value"), "reference")
    return windows.bin_drift(drained(windows.window_bins(as_stream(events, "values"), reference, "value")), reference)


@register("stream_sketch_drift")
def stream_sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a sketch of each day (no SQL: a sketch is near, not equal; tests hold it against stream_psi)."""
    week, events = week_and_events(spark, sf_dir)
    days = drained(windows.window_sketches(as_stream(events, "values"), ["value"]))
    return windows.sketch_drift(days, windows.reference_sketch(week, ["value"]), ["value"])

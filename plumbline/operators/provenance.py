"""Verification of hash-chained inference logs: linkage, truncation, replay, checks, findings and their matrix.

Records are rows: log_id, line (arrival order within a log, which is data), sequence, digest (recomputed from content by
the caller, never read from the record), previous (the pointer that the record carries), nonce, key_id, subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.sources.shared import written

#: Failure code -> attack class, severity.
FAILURES = {
    "INVALID_SIGNATURE": ("inference_tampering", "CRITICAL"),
    "MISSING_SIGNATURE": ("provenance_key_trust", "HIGH"),
    "MALFORMED_SIGNATURE": ("inference_tampering", "HIGH"),
    "UNKNOWN_KEY": ("provenance_key_trust", "HIGH"),
    "REVOKED_KEY": ("provenance_key_trust", "HIGH"),
    "KEY_EXPIRED": ("provenance_key_trust", "MEDIUM"),
    "KEY_NOT_YET_VALID": ("provenance_key_trust", "MEDIUM"),
    "KEY_PURPOSE_MISMATCH": ("provenance_key_trust", "MEDIUM"),
    "INPUT_MISMATCH": ("inference_tampering", "CRITICAL"),
    "MODEL_MISMATCH": ("inference_tampering", "CRITICAL"),
    "CONFIGURATION_MISMATCH": ("inference_tampering", "HIGH"),
    "OUTPUT_MISMATCH": ("inference_tampering", "CRITICAL"),
    "SELF_INCONSISTENT_RECORD": ("inference_tampering", "HIGH"),
    "CHAIN_BREAK": ("record_reordering", "HIGH"),
    "REPLAY": ("inference_replay", "HIGH"),
    "MALFORMED_RECORD": ("inference_tampering", "MEDIUM"),
    "MISSING_FIELD": ("inference_tampering", "MEDIUM"),
    "UNSUPPORTED_SCHEMA": ("inference_tampering", "MEDIUM"),
}
#: Codes that need a trust store.
TRUST_CODES = ("UNKNOWN_KEY", "REVOKED_KEY", "KEY_EXPIRED", "KEY_NOT_YET_VALID", "KEY_PURPOSE_MISMATCH")
#: Expected fields -> check, failure code.
EXPECTATIONS = {
    "raw_input_digest": ("input_digest_match", "INPUT_MISMATCH"),
    "normalized_input_digest": ("normalized_input_digest_match", "INPUT_MISMATCH"),
    "model_file_sha256": ("model_digest_match", "MODEL_MISMATCH"),
    "model_graph_digest": ("model_graph_digest_match", "MODEL_MISMATCH"),
    "model_parameter_digest": ("model_parameter_digest_match", "MODEL_MISMATCH"),
    "model_id": ("model_id_match", "MODEL_MISMATCH"),
    "preprocessing_digest": ("preprocessing_digest_match", "CONFIGURATION_MISMATCH"),
    "inference_digest": ("inference_digest_match", "CONFIGURATION_MISMATCH"),
    "output_digest": ("output_digest_match", "OUTPUT_MISMATCH"),
    "log_id": ("log_id_match", "CHAIN_BREAK"),
}
REPLAYS = ("REPLAY_EXACT", "NONCE_REUSE", "SEQUENCE_COLLISION")


def record_digest(*fields: Column) -> Column:
    """SHA-256 over fields in their order; a null is told apart from an empty text."""
    return fi.sha256(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("~")) for f in fields)))


def chain_links(records: DataFrame) -> DataFrame:
    """records with position, link (GENESIS, LINKED, BROKEN, ORPHANED) and in_sequence; every record is judged.

    Records are dealt by ranges of (log_id, line), so that one log may be many segments.  A segment numbers and links its own
    records; its length and last digest, a row for each segment of a log, tell the next one where it stands.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(records.repartitionByRange(parts, "log_id", "line").withColumn("__segment", F.spark_partition_id()), "chain-segments")
    edges = dealt.groupBy("__segment", F.col("log_id").alias("__log")).agg(F.count("*").alias("__n"), F.max(F.struct("line", "digest"))["digest"].alias("__end"))
    before = Window.partitionBy("__log").orderBy("__segment")  # a row for each segment of the log
    ahead = edges.select("__segment", "__log", F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.lag("__end").over(before).alias("__last"))
    own = Window.partitionBy("__segment", "log_id").orderBy("line", "digest")
    placed = dealt.withColumn("__own", F.row_number().over(own) - 1).withColumn("__before", F.lag("digest").over(own)).withColumnRenamed("__segment", "__part")
    placed = placed.join(ahead, (F.col("__part") == F.col("__segment")) & F.col("log_id").eqNullSafe(F.col("__log")))
    placed = placed.withColumn("position", (F.col("__own") + F.col("__ahead")).cast("long")).withColumn("__before", F.when(F.col("__own") == 0, F.col("__last")).otherwise(F.col("__before")))
    first = F.when(F.col("previous").isNull(), "GENESIS").otherwise("ORPHANED")
    link = F.when(F.col("position") == 0, first).when(F.col("previous").isNull(), "BROKEN").when(F.col("previous") == F.col("__before"), "LINKED").otherwise("BROKEN")
    in_sequence = F.coalesce(F.col("sequence") == F.col("position"), F.lit(False))
    return placed.select(*records.columns, "position", link.alias("link"), in_sequence.alias("in_sequence"))


def chain_summary(links: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """A row for each log: entries, broken, status, and truncation against its anchor (log_id, head, entries).

    Without anchors, or without one for a log, truncation at the end is NOT_DETECTABLE.
    """
    bad = ~F.col("link").isin("GENESIS", "LINKED") | ~F.col("in_sequence")
    logs = links.groupBy("log_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("broken"), F.max_by("digest", "position").alias("head"), F.max(F.struct((F.col("position") == 0).alias("z"), (F.col("link") == "ORPHANED").alias("o")))["o"].alias("front")
    )
    if anchors is None:
        anchors = links.sparkSession.createDataFrame([], "log_id string, head string, entries long")
    known = anchors.select(F.col("log_id").cast("string").alias("log_id"), F.col("head").alias("a_head"), F.col("entries").alias("a_n"))
    inside = links.select(F.col("log_id").cast("string").alias("log_id"), F.col("digest").alias("a_head")).join(known.drop("a_n"), ["log_id", "a_head"], "left_semi").select("log_id").distinct().withColumn("inside", F.lit(True))
    out = logs.withColumn("log_id", F.col("log_id").cast("string")).join(known, "log_id", "left").join(inside, "log_id", "left")
    truncation = (
        F.when(F.col("front"), "FRONT_TRUNCATION_DETECTED")
        .when(F.col("a_head").isNull(), "NOT_DETECTABLE")
        .when((F.col("a_head") == F.col("head")) & (F.col("a_n") == F.col("n")), "VERIFIED_COMPLETE")
        .when(F.col("inside") & (F.col("a_head") != F.col("head")), "ANCHOR_STALE")
        .when(F.col("inside"), "ANCHOR_MISMATCH")
        .when(F.col("n") < F.col("a_n"), "TRUNCATION_DETECTED")
        .otherwise("ANCHOR_MISMATCH")
    )
    return out.select("log_id", "n", "broken", F.when(F.col("broken") > 0, "BROKEN").otherwise("INTACT").alias("status"), truncation.alias("truncation"))


def build_anchors(links: DataFrame) -> DataFrame:
    """log_id, head, entries of logs as they are now, to be kept out of band."""
    return links.groupBy(F.col("log_id").cast("string").alias("log_id")).agg(F.max_by("digest", "position").alias("head"), F.count("*").alias("entries"))


def replay_verdicts(records: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """records (seen: order of presentation) with verdict and prior; observed rows come before all of them.

    The first rule that holds decides: equal digest, nonce of the same key, slot of the same log, subject (which is no replay).
    """
    cols = ["seen", "digest", "key_id", "nonce", "log_id", "sequence", "subject"]
    rows = records.select(*cols, F.lit(1).alias("turn"))
    if observed is not None:
        rows = rows.unionByName(observed.select(*cols, F.lit(0).alias("turn")))

    def prior(*key: str) -> Column:
        # Rows without the key are partitions of their own, not one partition of nulls.
        alone = F.when(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key)), F.xxhash64("seen", "turn"))
        before = Window.partitionBy(*key, alone).orderBy("turn", "seen").rowsBetween(Window.unboundedPreceding, -1)
        return F.last("seen").over(before)

    keys = (("digest",), ("key_id", "nonce"), ("log_id", "sequence"), ("subject",))
    names = (*REPLAYS, "DUPLICATE_SUBJECT")
    for name, key in zip(names, keys, strict=True):
        rows = rows.withColumn(f"__{name}", F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)), prior(*key)))
    verdict = F.coalesce(*(F.when(F.col(f"__{n}").isNotNull(), n) for n in names), F.lit("FIRST_OBSERVATION"))
    return rows.where("turn = 1").select(*cols, verdict.alias("verdict"), F.coalesce(*(F.col(f"__{n}") for n in names)).alias("prior"))


def observe(observed: DataFrame, records: DataFrame, keep_from=None) -> DataFrame:
    """The observations after these records: what is new by digest is added, what is older than keep_from is dropped."""
    new = records.join(observed.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    out = observed.unionByName(new.select(observed.columns))
    return out if keep_from is None else out.where(F.col("first_seen") >= keep_from)


def expectation_checks(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """A row for each record and expected field: check, outcome (PASS, FAIL, NOT_CHECKED) and failure code."""
    fields = [f for f in EXPECTATIONS if f in expected.columns and f in records.columns]
    both = records.select(key, *(F.col(f).alias(f"r_{f}") for f in fields)).join(expected.select(key, *(F.col(f).alias(f"e_{f}") for f in fields)), key, "left")
    rows = []
    for f in fields:
        check, code = EXPECTATIONS[f]
        r, e = F.col(f"r_{f}"), F.col(f"e_{f}")
        outcome = F.when(e.isNull(), "NOT_CHECKED").when(r.isNull() | (r != e), "FAIL").otherwise("PASS")
        failure = F.when(outcome == "FAIL", F.when(r.isNull(), "MISSING_FIELD").otherwise(code))
        rows.append(F.struct(F.lit(check).alias("check"), outcome.alias("outcome"), failure.alias("failure")))
    return both.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")


def key_checks(records: DataFrame, trust: DataFrame | None, key: str, purpose: str = "inference") -> DataFrame:
    """Checks of signing keys: known, trusted, inside their window, of the right purpose.

    Without a trust store they are NOT_CHECKED and the key is unknown; an unreadable time is unknown, not valid.
    """
    if trust is None:
        checks = ("key_known", "key_trusted", "key_within_validity_window", "key_purpose_permitted")
        rows = F.array(*(F.struct(F.lit(c).alias("check"), F.lit("NOT_CHECKED").alias("outcome"), F.lit("UNKNOWN_KEY" if c == "key_known" else None).cast("string").alias("failure")) for c in checks))
        return records.select(key, F.explode(rows).alias("c")).select(key, "c.*")
    table = F.broadcast(trust.select(F.col("key_id").alias("t_key"), "status", "valid_from", "valid_until", F.col("purpose").alias("t_purpose")))  # a row for each key
    both = records.join(table, records["key_id"] == F.col("t_key"), "left")
    at, start, end = (F.try_to_timestamp(F.col(c)) for c in ("signed_at", "valid_from", "valid_until"))
    known = F.col("t_key").isNotNull()
    early, late = start.isNotNull() & (at < start), end.isNotNull() & (at > end)
    window = F.when(~known | at.isNull(), "NOT_CHECKED").when(early | late, "FAIL").otherwise("PASS")

    def row(name: str, outcome: Column, failure: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), outcome.alias("outcome"), F.when(outcome == "FAIL", failure).alias("failure"))

    trusted = F.when(known & (F.col("status") == "TRUSTED"), "PASS").otherwise("FAIL")
    permitted = F.when(~known, "NOT_CHECKED").when(F.col("t_purpose").isin(purpose, "any"), "PASS").otherwise("FAIL")
    rows = F.array(
        row("key_known", F.when(known, "PASS").otherwise("FAIL"), F.lit("UNKNOWN_KEY")),
        row("key_trusted", trusted, F.when(F.col("status") == "REVOKED", "REVOKED_KEY").otherwise("UNKNOWN_KEY")),
        row("key_within_validity_window", window, F.when(early, "KEY_NOT_YET_VALID").otherwise("KEY_EXPIRED")),
        row("key_purpose_permitted", permitted, F.lit("KEY_PURPOSE_MISMATCH")),
    )
    return both.select(key, F.explode(rows).alias("c")).select(key, "c.*")


def chain_checks(links: DataFrame, key: str) -> DataFrame:
    """previous_record_valid and sequence_valid of each record."""
    ok = F.col("link").isin("GENESIS", "LINKED")
    pair = [("previous_record_valid", ok), ("sequence_valid", F.col("in_sequence"))]
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.when(c, "PASS").otherwise("FAIL").alias("outcome"), F.when(~c, "CHAIN_BREAK").alias("failure")) for n, c in pair))
    return links.select(key, F.explode(rows).alias("c")).select(key, "c.*")


def replay_checks(verdicts: DataFrame, key: str) -> DataFrame:
    bad = F.col("verdict").isin(*REPLAYS)
    return verdicts.select(key, F.lit("replay_detected").alias("check"), F.when(bad, "FAIL").otherwise("PASS").alias("outcome"), F.when(bad, "REPLAY").alias("failure"))


def verification_matrix(checks: DataFrame) -> DataFrame:
    """Counts of outcomes by check; an outcome that did not occur counts 0."""
    return checks.groupBy("check").agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("PASS", "FAIL", "NOT_CHECKED", "OBSERVED")))


def failure_findings(checks: DataFrame, key: str, with_trust: bool = True) -> DataFrame:
    """One finding for each failure code of a record, whatever the number of checks that show it."""
    spark = checks.sparkSession
    table = spark.createDataFrame([(c, a, s) for c, (a, s) in FAILURES.items()], "failure string, attack_class string, severity string")
    rows = checks.where("failure is not null").groupBy(key, "failure").agg(F.count("*").alias("evidence")).join(F.broadcast(table), "failure")
    coverage = F.when(F.col("failure").isin(*TRUST_CODES) & F.lit(not with_trust), "NOT_ASSESSED").otherwise("SUPPORTED")
    what, why = fi.disposition(F.col("severity"), F.lit(1.0), F.lit("DETERMINISTIC"), coverage)
    return rows.select(key, "failure", "attack_class", "severity", "evidence", coverage.alias("coverage"), what.alias("disposition"), why.alias("disposition_rule"))

"""Checks of single inference records and of the keys that signed them, and the trust store as a table of decisions.

A check is a row (record, check, outcome, failure); outcomes are PASS, FAIL, NOT_CHECKED, NOT_APPLICABLE and OBSERVED.  What
a check could not find out is never a PASS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import findings as fi

#: The record schemas that are understood, and the failure of each outcome of a signature's verification.
SCHEMAS = ("1.0",)
SIGNATURES = {"VALID": None, "INVALID": "INVALID_SIGNATURE", "MALFORMED": "MALFORMED_SIGNATURE", "MISSING": "MISSING_SIGNATURE", "UNSUPPORTED_ALGORITHM": "MALFORMED_SIGNATURE"}
#: Parts of a record that carry their own digest -> check, failure code.
BINDINGS = {
    "preprocessing": ("preprocessing_digest_self_consistent", "CONFIGURATION_MISMATCH"),
    "inference": ("inference_config_digest_self_consistent", "CONFIGURATION_MISMATCH"),
    "output": ("output_digest_self_consistent", "OUTPUT_MISMATCH"),
}


def entry_digest(payload: Column, signature: Column) -> Column:
    """Digest of a log entry: of what it says and of its signature, so that neither can be exchanged."""
    return fi.sha256(fi.canonical_json(payload=payload, signature=signature))


def subject_key(input_: Column, model: Column, preprocessing: Column, inference: Column) -> Column:
    """What an inference is about, whoever recorded it and when."""
    return fi.sha256(fi.canonical_json(inference=inference, input=input_, model=model, preprocessing=preprocessing))


def _row(check: str, outcome: Column, failure: Column | str | None = None) -> Column:
    code = failure if isinstance(failure, Column) else F.lit(failure).cast("string")
    return F.struct(F.lit(check).alias("check"), outcome.alias("outcome"), F.when(outcome == "FAIL", code).alias("failure"))


def _passes(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "PASS").otherwise("FAIL")


def _checks(records: DataFrame, key: str, rows: list[Column]) -> DataFrame:
    return records.select(key, F.explode(F.array_compact(F.array(*rows))).alias("c")).select(key, "c.*")


def record_checks(records: DataFrame, key: str, schemas: tuple[str, ...] = SCHEMAS) -> DataFrame:
    """Schema, identity, self-consistency, required fields; presence of time and nonce is observed, not believed.

    records: schema_version, record_id, content_digest (recomputed), <binding>_digest and <binding>_content (its canonical
    text) for each of BINDINGS, nonce, timestamp, log_id.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    rows = [
        _row("schema_supported", _passes(F.col("schema_version").isin(*schemas)), "UNSUPPORTED_SCHEMA"),
        _row("record_id_matches_content", _passes(F.col("record_id") == F.col("content_digest")), "SELF_INCONSISTENT_RECORD"),
        *(_row(check, _passes(F.col(f"{part}_digest") == fi.sha256(F.col(f"{part}_content"))), code) for part, (check, code) in BINDINGS.items()),
        _row("required_fields_present", _passes(reduce(lambda a, b: a & b, map(filled, ("nonce", "timestamp", "log_id")))), "MISSING_FIELD"),
        _row("timestamp_present", F.lit("OBSERVED")),
        _row("nonce_present", F.lit("OBSERVED")),
    ]
    return _checks(records, key, rows)


def signature_checks(records: DataFrame, key: str) -> DataFrame:
    """signature_valid from signature_outcome (the answer of a verification)."""
    code = F.element_at(F.create_map(*(F.lit(v) for k, c in SIGNATURES.items() if c for v in (k, c))), F.col("signature_outcome"))
    return _checks(records, key, [_row("signature_valid", _passes(F.col("signature_outcome") == "VALID"), F.coalesce(code, F.lit("MALFORMED_SIGNATURE")))])


def authority_checks(records: DataFrame, trust: DataFrame | None, key: str, purpose: str = "inference") -> DataFrame:
    """Whether the key that signed a record had the authority to: known, trusted, in its window, of the right purpose.

    records: key_id, key_id_consistent (does the key's name fingerprint it), timestamp.  trust: key_id, status, valid_from,
    valid_until, purpose, revoked_at.  A record that names no key, or another than signed it, has no signer to look up; that
    a revoked key's record claims an earlier time is observed and changes nothing.
    """
    none = F.col("key_id").isNull()
    forged = ~none & F.coalesce(~F.col("key_id_consistent"), F.lit(False))
    if trust is None:
        says = F.when(none, "NOT_APPLICABLE").otherwise("NOT_CHECKED")
        known = F.struct(F.lit("key_known").alias("check"), says.alias("outcome"), F.when(~none, "UNKNOWN_KEY").alias("failure"))
        return _checks(records, key, [known, _row("key_trusted", says)])
    columns = ("status", "valid_from", "valid_until", "purpose", "revoked_at")
    store = F.broadcast(trust.select(F.col("key_id").alias("t_key"), *(F.col(c).alias(f"t_{c}") for c in columns)))  # a row for each key
    both = records.join(store, (F.col("key_id") == F.col("t_key")) & ~forged, "left")
    found, c = F.col("t_key").isNotNull(), F.col
    at, start, end = (F.try_to_timestamp(x) for x in (c("timestamp"), c("t_valid_from"), c("t_valid_until")))
    open_ended = c("t_valid_from").isNull() & c("t_valid_until").isNull()
    outside = c("t_valid_from").isNotNull() & (start.isNull() | (at < start)) | c("t_valid_until").isNotNull() & (end.isNull() | (at > end))
    window = F.when(open_ended, "NOT_APPLICABLE").when(at.isNull() | outside, "FAIL").otherwise("PASS")
    early = c("t_valid_from").isNotNull() & F.coalesce(at < start, c("timestamp") < c("t_valid_from"))
    why = F.when(at.isNull(), "MALFORMED_RECORD").when(early, "KEY_NOT_YET_VALID").otherwise("KEY_EXPIRED")
    known = F.struct(F.lit("key_known").alias("check"), F.when(none | forged, "NOT_APPLICABLE").otherwise(_passes(found)).alias("outcome"), F.when(~none & (forged | ~found), "UNKNOWN_KEY").alias("failure"))
    trusted = F.when(none | forged, "NOT_APPLICABLE").otherwise(_passes(c("t_status") == "TRUSTED"))
    permitted = _passes(c("t_purpose").isin(purpose, "any") | F.lit(purpose == "any"))
    rows = [
        known,
        _row("key_trusted", trusted, F.when(c("t_status") == "REVOKED", "REVOKED_KEY").otherwise("UNKNOWN_KEY")),
        F.when(found & (c("t_status") == "REVOKED"), _row("signed_before_revocation", F.lit("OBSERVED"))),
        F.when(found, _row("key_within_validity_window", window, why)),
        F.when(found, _row("key_purpose_permitted", permitted, "KEY_PURPOSE_MISMATCH")),
    ]
    return _checks(both, key, rows)


def apply_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions (seq, operation, key_id, fingerprint, reason, at, valid_from, valid_until, purpose) -> the store, and what was refused.

    Trusting needs a key id that fingerprints the key; revoking needs a key in the store and a reason, and keeps what the
    key was; untrusting needs a key in the store and makes it UNKNOWN.  Each key's decisions are applied in their order.
    """
    order = Window.partitionBy("key").orderBy("seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    op, named = F.col("operation"), F.col("key_id").isNull() | (F.col("key_id") == F.col("fingerprint"))
    rows = decisions.withColumn("key", F.when(op == "trust", F.col("fingerprint")).otherwise(F.col("key_id")))
    present = F.coalesce(F.max((op == "trust") & named).over(before), F.lit(False))
    refused = (
        F.when((op == "trust") & ~named, "KEY_ID_MISMATCH").when(op == "trust", None)
        .when(~op.isin("revoke", "untrust"), "UNKNOWN_OPERATION").when(~present, "NOT_IN_STORE")
        .when((op == "revoke") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "NO_REASON")
    )
    rows = rows.withColumn("refused", refused)
    good = F.col("refused").isNull()
    status = F.create_map(*(F.lit(x) for x in ("trust", "TRUSTED", "revoke", "REVOKED", "untrust", "UNKNOWN")))
    kept = lambda c, when: F.last(F.when(when & good, F.struct(c)), ignorenulls=True).over(upto)[c]
    state = rows.select(
        F.col("key").alias("key_id"), "seq", "refused", F.element_at(status, kept("operation", F.lit(True))).alias("status"),
        *(kept(c, op == "trust").alias(c) for c in ("valid_from", "valid_until", "purpose")),
        F.when(kept("operation", F.lit(True)) == "revoke", kept("at", op == "revoke")).alias("revoked_at"),
        F.when(kept("operation", F.lit(True)) != "trust", kept("reason", op != "trust")).alias("reason"),
    )
    last = state.groupBy("key_id").agg(F.max_by(F.struct("status", "valid_from", "valid_until", "purpose", "revoked_at", "reason"), "seq").alias("s")).select("key_id", "s.*")
    return last.where("status is not null"), rows.where(~good).select("seq", "operation", "key_id", "refused")

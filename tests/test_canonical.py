"""Canonical texts against what they refuse, and logs whose records are sealed by them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical
from plumbline.functions import signatures as sg
from plumbline.plans import pipelines

SECRET = bytes(range(32))
KEY = sg.public_key(SECRET)
KEY_ID = hashlib.sha256(KEY).hexdigest()


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ('{"score": 0.5}', "FLOAT"), ('{"v": NaN}', "NON_FINITE"), ('{"v": -Infinity}', "NON_FINITE"), ('{"v": 9007199254740992}', "UNSAFE_INTEGER"), ('{"v": ' + "9" * 5000 + "}", "UNSAFE_INTEGER"), ("{1: 2}", "NOT_JSON"), ("", "NOT_JSON"),
        ('{"a": 1, "a": 1}', "REPEATED_KEY"), ('[{"b": {"a": 1, "a": 2}}]', "REPEATED_KEY"), ("[" * 100_000, "TOO_DEEP"), ('{"v": 1e3}', "FLOAT"),
    ],
)
def test_what_is_refused(text, fault):
    with pytest.raises(canonical.Refused, match=fault):
        canonical.parse(text)


def test_equal_values_have_one_text():
    a, b = '{"b": [1, 2, {"y": null, "x": true}], "a": "\\u0938é"}', ' {"a":"सé","b":[1,2,{"x":true,"y":null}]}'
    assert canonical.write(canonical.parse(a)) == canonical.write(canonical.parse(b)) == '{"a":"सé","b":[1,2,{"x":true,"y":null}]}'
    assert canonical.write(canonical.parse('{"v": 9007199254740991, "z": 0.125}', 3)) == '{"v":9007199254740991,"z":{"$q":125,"p":3}}'
    assert canonical.write(canonical.parse('{"z": 0.125}', 2)) == '{"z":{"$q":12,"p":2}}'
    assert canonical.parse("0.30000000000000004", 6) == canonical.parse("0.3", 6)
    with pytest.raises(canonical.Refused, match="NON_FINITE"):
        canonical.parse("1e999", 6)


def test_columns_and_parts(spark):
    rows = [(1, '{"r": {"id": "x", "b": 2, "a": 1}, "s": [2, 1]}'), (2, '{"r": 0.5}'), (3, None), (4, '{"r": 5}'), (5, "nope"), (6, '{"k": "\\ud800"}')]
    df = spark.createDataFrame(rows, "i int, t string").repartition(2)
    got = {r.i: r.c for r in df.select("i", canonical.canonical_parts(F.col("t"), {"all": "", "r": "r", "less": ("r", "id"), "deep": "r.a", "none": "q.z"}).alias("c")).collect()}
    assert tuple(got[1]) == ('{"r":{"a":1,"b":2,"id":"x"},"s":[2,1]}', '{"a":1,"b":2,"id":"x"}', '{"a":1,"b":2}', "1", None, None)
    assert tuple(got[2]) == (None, None, None, None, None, "FLOAT") and got[5].fault == "NOT_JSON" and got[6].fault == "NOT_JSON"
    assert tuple(got[3]) == (None,) * 6 and tuple(got[4]) == ('{"r":5}', "5", "5", None, None, None)


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def sealed_log(path, edit=None, n=5):
    """A signed log; edit(i, entry) may change an entry after it was sealed."""
    lines, previous = [], None
    for i in range(n):
        config, out = {"size": 8 * i}, {"label": "cat", "score": 900_000}
        record = {
            "schema_version": "1.0", "nonce": f"n{i}", "timestamp": "2024-01-01T00:00:00Z", "input": {"raw_input_digest": f"i{i}"}, "model": {"file_sha256": "m"}, "preprocessing": {"digest": sha(config), "config": config},
            "inference": {"digest": sha({}), "config": {}}, "output": {"digest": sha(out), "output": out}, "sequence": {"log_id": "l", "sequence_number": i, "previous_record_digest": previous},
        }
        record["record_id"] = "PR-" + sha(record)[:16]
        payload = json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()
        entry = {"record": record, "signature": {"algorithm": "ed25519", "key_id": KEY_ID, "public_key": KEY.hex(), "signature": sg.sign(SECRET, payload).hex()}}
        previous = sha(entry)
        if edit:
            edit(i, entry)
        lines.append(json.dumps(entry, indent=None, ensure_ascii=i % 2 == 0))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def failures(spark, path, trust):
    report = pipelines.verify_log(spark, path, trust, whole=True)
    checks = report.tables["checks"].where("outcome = 'FAIL'").select("check", "failure").collect()
    return {(r.check, r.failure) for r in checks}, report


def test_whole_checks_of_a_sealed_log(spark, tmp_path):
    kind = "key_id string, status string, valid_from string, valid_until string, purpose string, revoked_at string"
    trust = spark.createDataFrame([(KEY_ID, "TRUSTED", None, None, "any", None)], kind)
    good, report = failures(spark, sealed_log(tmp_path / "good.jsonl"), trust)
    assert good == set() and report.findings.count() == 0
    names = {r.check for r in report.tables["checks"].select("check").distinct().collect()}
    assert {"record_id_matches_content", "output_digest_self_consistent", "signature_valid", "key_known", "required_fields_present", "schema_supported"} <= names

    def config(i, entry):
        if i == 1:
            entry["record"]["preprocessing"]["config"]["size"] = 9

    found, _ = failures(spark, sealed_log(tmp_path / "config.jsonl", config), trust)
    assert {("preprocessing_digest_self_consistent", "CONFIGURATION_MISMATCH"), ("record_id_matches_content", "SELF_INCONSISTENT_RECORD"), ("signature_valid", "INVALID_SIGNATURE"), ("previous_record_valid", "CHAIN_BREAK")} <= found

    def score(i, entry):
        if i == 2:
            entry["record"]["output"]["output"]["score"] = 0.9

    found, report = failures(spark, sealed_log(tmp_path / "float.jsonl", score), trust)
    assert ("canonical_form", "MALFORMED_RECORD") in found and report.tables["matrix"].where("check = 'canonical_form'").first().fail == 1

    def signature(i, entry):
        if i == 3:
            entry["signature"]["signature"] = "00" * 64

    found, _ = failures(spark, sealed_log(tmp_path / "signature.jsonl", signature), trust)
    assert ("signature_valid", "INVALID_SIGNATURE") in found and ("record_id_matches_content", "SELF_INCONSISTENT_RECORD") not in found
    found, _ = failures(spark, sealed_log(tmp_path / "revoked.jsonl"), spark.createDataFrame([(KEY_ID, "REVOKED", None, None, "any", "2024-02-01")], kind))
    assert found == {("key_trusted", "REVOKED_KEY")}

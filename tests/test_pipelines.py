"""Whole assessments end to end, with the truth kept apart."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.operators import scenarios
from plumbline.plans import pipelines


def corpus(spark):
    rows = [(i, " ".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest()[:5] for k in range(40)), "ab"[i % 2], f"c{i % 4}") for i in range(80)]
    return spark.createDataFrame(rows, "sample_id long, content string, label string, contributor string")


def test_scan_of_a_flooded_dataset(spark):
    samples, truth = scenarios.duplicate_flood(corpus(spark), "c2", 2, 7)
    samples = samples.withColumn("id", F.xxhash64("sample_id"))
    report = pipelines.scan_dataset(samples)
    found = report.findings.collect()
    assert {r.detector for r in found} == {"exact_duplicate", "contributor_aggregate"} and {r.contributor for r in found} == {"c2"}
    cover = {r.attack_class: r.coverage for r in report.coverage.collect()}
    assert cover["duplicate_flood"] == "SUPPORTED" and cover["label_flip"] == cover["ood_insertion"] == "NOT_ASSESSED"
    assert report.digest() == pipelines.scan_dataset(samples).digest()
    clean = pipelines.scan_dataset(corpus(spark).withColumnRenamed("sample_id", "id"))
    assert clean.findings.count() == 0
    out = pipelines.assess("x", dataset=clean)
    assert out["overall"].first().disposition == "NOT_ASSESSED"
    assert {r.rule for r in out["rules"].collect()} == {"PROV-000", "MODEL-000", "DATA-010", "SHIFT-000"}


def write_log(path, edit=None, drop=None):
    lines, previous = [], None
    for i in range(6):
        record = {"record": {"schema_version": "1.0", "record_id": f"r{i}", "nonce": f"n{i}", "input": {"raw_input_digest": f"i{i}"}, "sequence": {"log_id": "l", "sequence_number": i, "previous_record_digest": previous}}, "signature": {"key_id": "k", "signed_at": "2024-01-01T00:00:00Z"}}
        line = json.dumps(record, sort_keys=True)
        previous = hashlib.sha256(line.encode()).hexdigest()
        lines.append(line.replace(f"i{i}", "forged") if i == edit else line)
    path.write_text("\n".join(x for i, x in enumerate(lines) if i != drop) + "\n")
    return str(path)


def test_log_verification_and_fusion(spark, tmp_path):
    trust = spark.createDataFrame([("k", "TRUSTED", None, None, "any")], "key_id string, status string, valid_from string, valid_until string, purpose string")
    good = pipelines.verify_log(spark, write_log(tmp_path / "good.jsonl"), trust)
    assert good.findings.count() == 0 and good.tables["logs"].first().truncation == "NOT_DETECTABLE"
    forged = pipelines.verify_log(spark, write_log(tmp_path / "forged.jsonl", edit=2), trust)
    assert {r.attack_class for r in forged.findings.collect()} == {"record_reordering"}
    assert forged.tables["matrix"].where("check = 'previous_record_valid'").first().fail == 1
    out = pipelines.assess("case", log=forged)
    row = out["overall"].first()
    assert (row.disposition, row.rule) == ("QUARANTINE", "PROV-001")
    unknown = pipelines.verify_log(spark, write_log(tmp_path / "plain.jsonl"))
    assert {r.disposition_rule for r in unknown.findings.collect()} == {"D-000"}
    cut = pipelines.verify_log(spark, write_log(tmp_path / "cut.jsonl", drop=0), trust)
    assert "chain_truncation" in {r.attack_class for r in cut.findings.collect()}


def test_an_assessment_needs_a_report():
    with pytest.raises(ValueError, match="at least one report"):
        pipelines.assess("x")


def test_command_line(capsys):
    assert main(["version"]) == 0 and main(["queries"]) == 0
    assert "exact_dup_groups" in capsys.readouterr().out


def test_copies_with_one_wrong_label_do_not_vote_for_each_other(spark):
    rows = [(i, f"text {i} of its own words {i * 7919} {i * i}", "a", [1.0, 0.001 * i]) for i in range(30)] + [(100 + i, f"other {i} says {i * 104729} {i**3}", "b", [0.001 * i, 1.0]) for i in range(30)]
    rows += [(1000 + i, "the very same text", "b", [1.0, 0.0005]) for i in range(90)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "id long, content string, label string, vector array<double>, contributor string")
    report = pipelines.scan_dataset(table.select("id", "content", "contributor"), table.select("id", "label", "vector"))
    got = {r.id: r for r in report.tables["labels"].collect()}
    assert all(got[1000 + i].flagged and got[1000 + i].suggested == "a" for i in range(90)) and len(got) == 150

"""The assessment of stored models at both levels of access, and what a case makes of it."""

import numpy as np
import pytest

from plumbline.__main__ import main
from plumbline.plans import pipelines
from plumbline.plans.model_pipeline import assess_model
from plumbline.sources import model_files
from plumbline.sources import stored_models as stored

KIND = "model int, position int, name string, rows int, columns int, values array<float>"


def write(spark, folder, change=None, producer="one", raw=True):
    rng = np.random.default_rng(1)
    rows = [(1, k, f"w{k}", 4, 4, [float(v) for v in rng.normal(size=16)]) for k in range(8)]
    if change:
        change(rows)
    stored.write_chain_models(spark.createDataFrame(rows, KIND), str(folder), producer, raw)
    return f"{folder}/1.onnx"


def classes(report):
    return {(r.attack_class, r.detector, r.severity, r.disposition) for r in report.findings.collect()}


def coverage(report):
    return {r.attack_class: r.coverage for r in report.coverage.collect()}


def test_the_same_model_is_clean(spark, tmp_path):
    path = write(spark, tmp_path / "a")
    report = assess_model(spark, path, path)
    assert report.findings.count() == 0
    assert coverage(report) == {"model_substitution": "SUPPORTED", "model_tampering": "SUPPORTED", "model_backdoor": "NOT_ASSESSED"}
    assert report.tables["identity"].first().relation == "IDENTICAL" and report.tables["concentration"].first().pattern == "none"
    assert {r.attack_class for r in report.tables["not_assessed"].collect()} == {"model_tampering", "model_backdoor"}
    assert {r.capability for r in report.tables["out_of_reach"].collect()} == {"inference", "activations", "gradients"}


def test_changed_weights_and_weights_that_are_no_numbers(spark, tmp_path):
    def one(rows):
        rows[3][5][2] += 1.0

    def nan(rows):
        rows[3][5][2] = float("nan")

    path, again, changed, broken = write(spark, tmp_path / "a"), write(spark, tmp_path / "b", None, "two", False), write(spark, tmp_path / "c", one), write(spark, tmp_path / "d", nan)
    assert classes(assess_model(spark, again, path)) == {("model_substitution", "model_identity", "MEDIUM", "REVIEW")}
    report = assess_model(spark, changed, path)
    assert classes(report) == {("model_substitution", "model_identity", "HIGH", "QUARANTINE")}
    assert report.tables["concentration"].first().pattern == "localised" and {r.name: r.status for r in report.tables["tensors"].collect()}["w3#0"] == "changed"
    assert classes(assess_model(spark, broken)) == {("model_tampering", "model_weights", "HIGH", "QUARANTINE")}
    out = pipelines.assess("case", model=report)["overall"].first()
    assert (out.disposition, out.rule) == ("QUARANTINE", "MODEL-001")


def test_a_black_box_shows_less_and_says_so(spark, tmp_path):
    def one(rows):
        rows[3][5][2] += 1.0

    path, changed = write(spark, tmp_path / "a"), write(spark, tmp_path / "c", one)
    report = assess_model(spark, changed, path, white_box=False)
    assert report.tables["identity"].first().relation == "DIFFERENT_BYTES_STRUCTURE_UNAVAILABLE" and "tensors" not in report.tables
    assert coverage(report) == {"model_substitution": "SUPPORTED", "model_tampering": "NOT_ASSESSED", "model_backdoor": "NOT_ASSESSED"}
    assert "weights are out of reach" in {r.reason for r in report.tables["not_assessed"].collect()}


def test_behaviour_triggers_and_their_corroboration(spark, tmp_path):
    pytest.importorskip("onnxruntime")

    def one(rows):
        rows[0][5][:] = [-v for v in rows[0][5]]

    path, changed = write(spark, tmp_path / "a"), write(spark, tmp_path / "c", one)
    rng = np.random.default_rng(2)
    probes = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(40)], "probe long, features array<float>")
    a, b = (model_files.infer(probes, p).selectExpr("probe", "'clean' AS category", "probabilities") for p in (changed, path))
    triggers = spark.createDataFrame([("patch", 0, 2)] * 9 + [("patch", 0, 0)] + [("noise", 1, k % 3) for k in range(9)], "trigger string, before int, after int")
    pairs = spark.createDataFrame([("flip", 1, k % 2) for k in range(10)], "kind string, before int, after int")
    report = assess_model(spark, changed, path, a, b, triggers, pairs, 0.7)
    got = classes(report)
    assert ("model_backdoor", "model_trigger", "HIGH", "REVIEW") in got and {c for c, *_ in got} == {"model_substitution", "model_tampering", "model_backdoor"}
    assert {r.kind for r in report.tables["floors"].collect()} == {"behavioural_divergence", "metamorphic_instability"}
    assert [(r.target, r.separation) for r in report.tables["corroborations"].collect()] == [(2, 0.7)]
    assert coverage(report)["model_backdoor"] == "PARTIAL"
    other = b.selectExpr("probe", "category", "slice(probabilities, 1, 3) AS probabilities")
    assert ("model_tampering", "model_behaviour", "CRITICAL", "QUARANTINE") in classes(assess_model(spark, path, path, other, b))


def test_a_path_without_a_model_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError, match="no model"):
        assess_model(spark, str(tmp_path))


def test_commands(spark, tmp_path, capsys):
    path = write(spark, tmp_path / "a")
    session = spark.conf.get("spark.checkpoint.dir")
    assert main(["model", "digests", path]) == 0 and "READ" in capsys.readouterr().out
    assert main(["model", "assess", path, "--reference", path, "--out", str(tmp_path / "report")]) == 0
    assert spark.read.json(str(tmp_path / "report" / "coverage")).count() == 3
    assert spark.conf.get("spark.checkpoint.dir") == session

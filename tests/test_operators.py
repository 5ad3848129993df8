"""Operators on hand-made fixtures: what the driver's tables do not hold."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import contributors, duplicates, fusion, graph, integrity, models, neighbours, provenance, shift
from plumbline.sources import datasets, logs


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hamming_bands_lose_no_pair(spark):
    codes = [(1, 0, 0), (2, 0b1111, 0b1111), (3, 0b11111, 0b1111), (4, 2**32 - 1, 0)]
    got = {(r.a, r.b, r.distance) for r in duplicates.hamming_pairs(spark.createDataFrame(codes, "id long, hi long, lo long")).collect()}
    assert got == {(1, 2, 8), (2, 3, 1)}


def test_chain_edit_breaks_exactly_the_next_link(spark):
    rows = [("a", i, i, f"d{i}" if i != 2 else "edited", f"d{i - 1}" if i else None) for i in range(5)]
    links = provenance.chain_links(spark.createDataFrame(rows, "log_id string, line long, sequence long, digest string, previous string"))
    assert [r.link for r in links.orderBy("line").collect()] == ["GENESIS", "LINKED", "LINKED", "BROKEN", "LINKED"]


def test_truncation_needs_an_anchor(spark):
    rows = [("a", i, i, f"d{i}", f"d{i - 1}" if i else None) for i in range(3)]
    links = provenance.chain_links(spark.createDataFrame(rows, "log_id string, line long, sequence long, digest string, previous string"))
    anchors = lambda head, n: spark.createDataFrame([("a", head, n)], "log_id string, head string, entries long")
    says = lambda a: provenance.chain_summary(links, a).first().truncation
    assert says(None) == "NOT_DETECTABLE"
    assert says(anchors("d2", 3)) == "VERIFIED_COMPLETE"
    assert says(anchors("d1", 2)) == "ANCHOR_STALE"
    assert says(anchors("d4", 5)) == "TRUNCATION_DETECTED"
    assert says(anchors("x", 2)) == "ANCHOR_MISMATCH"


def test_replay_rules_in_order(spark):
    rows = [(1, "d1", "k", "n1", "l", 0, "s"), (2, "d1", "k", "n1", "l", 0, "s"), (3, "d3", "k", "n1", "l", 5, None), (4, "d4", "k", "n4", "l", 0, None), (5, "d5", "k", "n5", "l", 9, "s"), (6, "d6", "k", "n6", "m", 1, "t")]
    got = provenance.replay_verdicts(spark.createDataFrame(rows, "seen long, digest string, key_id string, nonce string, log_id string, sequence long, subject string")).orderBy("seen").collect()
    assert [r.verdict for r in got] == ["FIRST_OBSERVATION", "REPLAY_EXACT", "NONCE_REUSE", "SEQUENCE_COLLISION", "DUPLICATE_SUBJECT", "FIRST_OBSERVATION"]


def test_observations_are_appended_once_and_pruned(spark):
    have = spark.createDataFrame([("a", 1)], "digest string, first_seen long")
    new = spark.createDataFrame([("a", 5), ("b", 6), ("b", 6)], "digest string, first_seen long")
    assert sorted(map(tuple, provenance.observe(have, new).collect())) == [("a", 1), ("b", 6)]
    assert [tuple(r) for r in provenance.observe(have, new, 2).collect()] == [("b", 6)]


def test_keys_without_a_store_are_not_checked(spark):
    rows = spark.createDataFrame([(1, "k", "2024-01-01")], "record long, key_id string, signed_at string")
    checks = provenance.key_checks(rows, None, "record")
    assert {r.outcome for r in checks.collect()} == {"NOT_CHECKED"}
    finding = provenance.failure_findings(checks, "record", with_trust=False).first()
    assert (finding.failure, finding.coverage, finding.disposition_rule) == ("UNKNOWN_KEY", "NOT_ASSESSED", "D-000")


def test_unreadable_time_is_unknown(spark):
    rows = spark.createDataFrame([(1, "k", "soon")], "record long, key_id string, signed_at string")
    trust = spark.createDataFrame([("k", "TRUSTED", "2000-01-01", "2001-01-01", "any")], "key_id string, status string, valid_from string, valid_until string, purpose string")
    got = {r.check: r.outcome for r in provenance.key_checks(rows, trust, "record").collect()}
    assert got == {"key_known": "PASS", "key_trusted": "PASS", "key_within_validity_window": "NOT_CHECKED", "key_purpose_permitted": "PASS"}


def test_calibration_falls_back_to_the_capped_prior(spark):
    table = contributors.calibration_table(spark.createDataFrame([(0.6, 1), (0.65, 0), (1.0, 1)], "score double, truth int"))
    assert table.count() == 6
    got = contributors.calibrated(spark.createDataFrame([(1.0,), (1.2,), (-0.5,)], "score double"), table, 0.9).orderBy("score").collect()
    assert [(r.basis, r.confidence <= 0.6) for r in got][0] == ("HEURISTIC_UNCALIBRATED", True)
    assert {r.basis for r in got[1:]} == {"CALIBRATED"}


def test_auroc_of_one_class_is_null(spark):
    assert contributors.auroc(spark.createDataFrame([(0.1, 1)] * 5, "score double, truth int")).first().auroc is None
    assert contributors.auroc(spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.3, 1)], "score double, truth int")).first().auroc == 1.0


def test_label_votes_leave_out_duplicates(spark):
    rows = [(i, "a", [1.0, 0.01 * i]) for i in range(9)] + [(100 + i, "b", [0.01 * i, 1.0]) for i in range(9)] + [(50, "b", [1.0, 0.005])]
    points = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    got = {r.id: r for r in neighbours.label_consistency(points).collect()}
    assert got[50].flagged and got[50].suggested == "a" and got[50].margin > 0 and not got[3].flagged
    mates = spark.createDataFrame([(50, i) for i in range(9)], "id long, mate long")
    assert not {r.id: r for r in neighbours.label_consistency(points, mates).collect()}[50].flagged


def test_small_populations_are_not_judged(spark):
    rows = spark.createDataFrame([(i, "reference" if i % 2 else "current", [float(i), 1.0]) for i in range(10)], "id long, side string, vector array<double>")
    assert shift.energy_statistic(rows).first().status == "INSUFFICIENT_SAMPLE"
    assert shift.energy_permutation_test(rows).first().status == "INSUFFICIENT_SAMPLE"
    assert shift.covariance_shift(rows).first().status == "INSUFFICIENT_SAMPLE"


def test_energy_sees_a_shift(spark):
    rows = spark.createDataFrame([(i, "reference" if i % 2 else "current", [float(i % 7) + (0 if i % 2 else 5), float(i % 3)]) for i in range(120)], "id long, side string, vector array<double>")
    assert shift.energy_permutation_test(rows, 199).first().p == pytest.approx(1 / 200)


def test_model_identity(spark):
    kind = "model string, file string, graph string, parameters string"
    a = spark.createDataFrame([("m1", "f", "g", "p"), ("m2", "f", "g", "p"), ("m3", "f", "g", "p"), ("m4", "f", "g", "p"), ("m5", "f", None, "p")], kind)
    b = spark.createDataFrame([("m1", "f", "g", "p"), ("m2", "x", "g", "p"), ("m3", "x", "g", "y"), ("m4", "x", "h", "y"), ("m5", "x", "g", "p")], kind)
    got = {r.model: (r.relation, r.severity) for r in models.identity(a, b).collect()}
    assert got == {"m1": ("IDENTICAL", None), "m2": ("RESERIALISED", "MEDIUM"), "m3": ("SAME_ARCHITECTURE_DIFFERENT_WEIGHTS", "HIGH"), "m4": ("DIFFERENT_MODEL", "CRITICAL"), "m5": ("DIFFERENT_BYTES_STRUCTURE_UNAVAILABLE", "HIGH")}


def test_change_of_one_tensor_is_localised(spark):
    kind = "name string, shape array<int>, values array<double>"
    ref = [(f"t{i}", [2], [1.0, 2.0]) for i in range(5)]
    got = models.compare_tensors(spark.createDataFrame([("t0", [2], [1.0, 3.0]), ("t1", [1, 2], [1.0, 2.0]), *ref[2:]], kind), spark.createDataFrame(ref, kind))
    assert {r.name: r.status for r in got.collect()} == {"t0": "changed", "t1": "reshaped", "t2": "identical", "t3": "identical", "t4": "identical"}
    assert models.change_concentration(got).first().pattern == "localised"


def test_fusion_of_named_cases(spark):
    cases = spark.createDataFrame([("clean", True, True, True), ("none", False, False, False), ("tamper", True, True, True), ("flip", True, True, True)], "case string, has_data boolean, has_model boolean, has_provenance boolean")
    found = spark.createDataFrame(
        [("tamper", "F-1", "inference_tampering", "prov", "CRITICAL", 1.0, "DETERMINISTIC", "SUPPORTED"), ("flip", "F-2", "label_flip", "labels", "MEDIUM", 0.45, "HEURISTIC_UNCALIBRATED", "SUPPORTED")],
        "case string, finding_id string, attack_class string, detector string, severity string, confidence double, basis string, coverage string",
    )
    moved = spark.createDataFrame([("clean", "NO_SHIFT_DETECTED"), ("tamper", "NO_SHIFT_DETECTED"), ("flip", "SHIFT_CONSISTENT_WITH_DECLARED_CONTEXT")], "case string, verdict string")
    out = fusion.rule_outcomes(cases, fusion.evidence(found, moved), moved)
    fired = {}
    for r in out.collect():
        fired.setdefault(r.case, set()).add(r.rule)
    assert {"PROV-010", "MODEL-010", "DATA-010", "SHIFT-010"} == fired["clean"]
    assert "PROV-001" in fired["tamper"] and "DATA-004" in fired["flip"] and "SHIFT-020" in fired["flip"]
    assert {r.case: r.disposition for r in fusion.overall(fusion.scope_decisions(out)).collect()} == {"clean": "ACCEPT", "none": "NOT_ASSESSED", "tamper": "QUARANTINE", "flip": "REVIEW"}


def test_coverage_that_nobody_reports_is_not_assessed(spark):
    registry = spark.createDataFrame([("a",), ("b",)], "attack_class string")
    reported = spark.createDataFrame([("a", "PARTIAL"), ("a", "SUPPORTED")], "attack_class string, coverage string")
    assert {r.attack_class: r.coverage for r in fusion.merge_coverage(registry, reported).collect()} == {"a": "SUPPORTED", "b": "NOT_ASSESSED"}


def test_boxes(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0],), ([5.0, 5.0, 5.0, 9.0],), ([0.0, 0.0, 12.0, 5.0],)], "b array<double>")
    got = [r[0] for r in rows.select(integrity.bbox_issue(F.col("b"), F.lit(10), F.lit(10))).collect()]
    assert got == [None, "invalid_bbox", "bbox_out_of_bounds"]
    assert [r[0] for r in rows.limit(1).select(integrity.centre_to_corners(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4)), F.lit(100), F.lit(50))).collect()][0] == pytest.approx([40, 15, 60, 35])


def test_coco_reader_records_defects(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 1, "file_name": "b.jpg"}, {"id": 2, "file_name": "c.jpg"}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [1, 2, 0, 4]}, {"id": 3, "image_id": 99, "category_id": 7, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 7, "name": "cat"}],
    }
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc))
    samples, issues = datasets.load(spark, str(path))
    rows = {r.sample_id: r for r in samples.collect()}
    assert rows["1"].labels == ["__unknown_9__", "cat"] and rows["1"].boxes[0].box == [1, 2, 4, 6] and rows["1"].relpath == "a.jpg"
    assert sorted(r.code for r in issues.collect()) == ["duplicate_id", "invalid_bbox", "orphan_annotation", "unknown_category", "unlabelled_sample"]


def test_folder_and_yolo_readers(spark, tmp_path):
    for name in ("cat/a.jpg", "dog/b.png", "dog/notes.md"):
        p = tmp_path / "folder" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    samples, issues = datasets.load(spark, str(tmp_path / "folder"))
    assert sorted((r.sample_id, r.labels) for r in samples.collect()) == [("cat/a.jpg", ["cat"]), ("dog/b.png", ["dog"])]
    assert [r.code for r in issues.collect()] == ["unsupported_extension"]
    root = tmp_path / "yolo"
    for name, text in (("images/a.jpg", "x"), ("images/b.jpg", "x"), ("labels/a.txt", "0 0.5 0.5 0.2 0.2\n9 0.5 0.5 0.1 0.1\n0 0.5 0.5 2 0.1\n0 0.5\n"), ("labels/z.txt", "0 0.5 0.5 0.2 0.2\n"), ("classes.txt", "cat\ndog\n")):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    samples, issues = datasets.load(spark, str(root))
    assert {r.sample_id: r.labels for r in samples.collect()} == {"a": ["cat"], "b": []}
    assert sorted(r.code for r in issues.collect()) == ["invalid_bbox", "malformed_record", "orphan_annotation", "unknown_category", "unlabelled_sample"]


def test_log_reader_keeps_bad_lines(spark, tmp_path):
    good = {"record": {"schema_version": "1.0", "sequence": {"log_id": "l", "sequence_number": 0}, "nonce": "n"}, "signature": {"key_id": "k"}}
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps(good) + "\n\nnot json\n")
    entries, bad = logs.read_log(spark, str(path))
    row = logs.flat(entries).first()
    assert (row.log_id, row.line, row.sequence, row.previous, row.key_id) == ("l", 1, 0, None, "k")
    assert [(r.line, r.raw) for r in bad.collect()] == [(3, "not json")]


def test_append_refuses_a_wrong_pointer(spark, tmp_path):
    kind = "log_id string, line long, sequence long, digest string, previous string, raw string"
    head = spark.createDataFrame([("l", "d1", 2)], "log_id string, head string, entries long")
    logs.append(spark.createDataFrame([("l", 1, 2, "d2", "d1", "{}")], kind), head, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="point back"):
        logs.append(spark.createDataFrame([("l", 1, 2, "d2", "x", "{}")], kind), head, str(tmp_path / "out"))


def test_reports_are_validated(spark, tmp_path):
    finding = {"finding_id": "F-1", "attack_class": "label_flip", "severity": "HIGH", "confidence": 1.0, "confidence_basis": "DETERMINISTIC", "method": "m", "coverage": "SUPPORTED", "disposition": "REVIEW", "disposition_rule": "D-110"}
    path = tmp_path / "report.json"
    path.write_text(json.dumps({"module": "dataset", "findings": [finding]}))
    assert logs.read_findings(spark, str(path), "dataset").count() == 1
    with pytest.raises(ValueError, match="no report"):
        logs.read_findings(spark, str(path), "model")
    path.write_text(json.dumps({"module": "dataset", "findings": [{**finding, "confidence": 0.5}]}))
    with pytest.raises(ValueError, match="break the schema"):
        logs.read_findings(spark, str(path), "dataset")


def test_covariances_read_every_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2400, 9))
    x[:, 0] *= 1 + 5 * (np.arange(2400) % 1200 > 999)
    rows = spark.createDataFrame([(i, "reference" if i < 1200 else "current", v.tolist()) for i, v in enumerate(x)], "id long, side string, vector array<double>")
    n, mean, products = neighbours.moments(rows)
    assert n == 2400 and np.allclose(mean, x.mean(0)) and np.allclose(products / (n - 1), np.cov(x.T))
    wide = rows.withColumn("vector", F.expr("case when side = 'current' then transform(vector, v -> 1.15 * v) else vector end"))
    got = shift.covariance_shift(wide, 8).first()
    assert got.status == "ASSESSED" and abs(got.statistic - 16 * math.log(1.15)) < 0.6 and got.p == pytest.approx(1 / 200)
    assert shift.covariance_shift(rows, 8).first().p > 0.01


def test_subspace_is_that_of_all_reference_rows(spark):
    rows = spark.range(20_100).select("id", F.lit(True).alias("reference"), F.array(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 500.0) for i in range(3))).alias("vector"))
    x = np.array([r.vector for r in rows.orderBy("id").collect()])
    got = np.array([r.residual for r in neighbours.ood_subspace_scores(rows, 2).orderBy("id").collect()])
    last = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][2]
    assert np.allclose(got, np.abs((x - x.mean(0)) @ last), atol=1e-7)


def test_hamming_pairs_equal_brute_force_and_have_no_hot_key(spark):
    import random

    rng = random.Random(2)
    codes = []
    for i in range(400):
        code = rng.getrandbits(64)
        codes.append((i, code))
        for k in range(rng.choice([0, 0, 1, 3])):
            other = code
            for bit in rng.sample(range(64), rng.randint(0, 10)):
                other ^= 1 << bit
            codes.append((1000 + 10 * i + k, other))
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for n, (a, x) in enumerate(codes) for b, y in codes[:n] if (x ^ y).bit_count() <= 8}
    df = spark.createDataFrame([(i, c >> 32, c & (2**32 - 1)) for i, c in codes], "id long, hi long, lo long")
    assert {(r.a, r.b, r.distance) for r in duplicates.hamming_pairs(df).collect()} == want
    word = F.shiftleft(F.col("hi"), 32).bitwiseOR(F.col("lo"))
    some = spark.createDataFrame([(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(2000)], "hi long, lo long")
    keys = some.select(F.explode(duplicates.band_keys(word)).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] < 20

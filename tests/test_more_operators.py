"""Features, canonical outputs, activations, roll-ups and seeded scenarios."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import activations, assessment, contributors, duplicates, features, outputs, provenance, scenarios, shift


def image(seed, h=48, w=64):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([np.sin(x / (5 + seed % 7)) + np.cos(y / (3 + c + seed % 3)) for c in range(3)], -1)
    return np.clip((base + 2) * 60 + rng.normal(0, 2, base.shape), 0, 255).astype(np.uint8)


def test_features_of_images(spark):
    a = image(1)
    rows = [("a", 48, 64, a.tobytes()), ("near", 48, 64, np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8).tobytes()), ("other", 48, 64, image(5).tobytes()), ("bad", 48, 64, b"x"), ("none", None, None, None)]
    got = {r.sample_id: r for r in features.image_features(spark.createDataFrame(rows, "sample_id string, height int, width int, rgb binary")).collect()}
    assert [got[k].valid for k in ("a", "near", "other", "bad", "none")] == [True, True, True, False, False]
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert far(got["a"].phash, got["near"].phash) <= 8 < far(got["a"].phash, got["other"].phash)
    e = {k: np.array(got[k].embedding) for k in ("a", "near", "other")}
    assert len(e["a"]) == sum(n for _, n in features.BLOCKS) == 614 and len(got["a"].acquisition) == 23
    assert np.linalg.norm(e["a"]) == pytest.approx(1, abs=1e-5) and e["a"] @ e["near"] > 0.95 > e["a"] @ e["other"]


def test_canonical_outputs_do_not_depend_on_order(spark):
    kind = "o array<struct<label:string,score:double>>"
    a, b = [("x", 0.5), ("y", 0.5), ("z", 0.9000001)], [("z", 0.9000001), ("y", 0.5), ("x", 0.5)]
    got = [r[0] for r in spark.createDataFrame([(a,), (b,)], kind).select(outputs.output_digest("classification", outputs.classification(F.col("o")))).collect()]
    assert got[0] == got[1]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([("x", math.nan)],)], kind).select(outputs.classification(F.col("o"))).collect()
    v = spark.createDataFrame([([0.1, 0.2],), ([0.1 + 1e-9, 0.2],), ([0.1, 0.3],)], "v array<double>").select(outputs.embedding_digest(F.col("v"))).collect()
    assert v[0] == v[1] != v[2]


def test_activation_measures_see_a_second_mode(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, (rng.normal(0, 1, 8) + (np.array([9.0] + [0] * 7) if i < 6 else 0)).tolist()) for i in range(40)] + [(100 + i, 1, rng.normal(0, 1, 8).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "probe long, predicted long, activation array<double>")
    flagged = activations.spectral(df).where("flagged")
    hit = activations.coincidence(flagged, df.where("probe < 6").select("probe")).first()
    assert hit.recall == 1.0 and hit.precision == 1.0
    two = activations.two_clusters(df).collect()
    assert [r.predicted for r in two] == [0] and two[0].minority_share == pytest.approx(6 / 40) and two[0].silhouette > 0.5
    assert activations.coincidence(flagged, df.where("probe < 0").select("probe")).first().recall is None


def test_model_levels_and_overall(spark):
    models = spark.createDataFrame([("clean", True), ("bad", True), ("black", False)], "model string, has_reference boolean")
    found = spark.createDataFrame([("bad", "identity", "HIGH", "QUARANTINE"), ("bad", "trigger", "MEDIUM", "REVIEW")], "model string, level string, severity string, disposition string")
    cover = spark.createDataFrame([(m, lv, "REQUIRES_WHITE_BOX" if m == "black" and lv in ("parameters", "activation") else "SUPPORTED") for m in ("clean", "bad", "black") for lv in assessment.LEVELS], "model string, level string, coverage string")
    levels = assessment.model_levels(models, found, cover)
    got = {(r.model, r.level): r.status for r in levels.collect()}
    assert got["clean", "identity"] == "VERIFIED" and got["bad", "identity"] == "MISMATCH" and got["bad", "trigger"] == "HIGH_RISK_INDICATOR"
    assert got["black", "identity"] == "NO_ANOMALY_DETECTED" and got["black", "parameters"] == "REQUIRES_WHITE_BOX"
    assert {r.model: r.overall for r in assessment.model_overall(levels, found).collect()} == {"clean": "NO ANOMALY DETECTED", "bad": "QUARANTINE REQUIRED", "black": "NO ANOMALY DETECTED — PARTIAL COVERAGE"}


def test_shift_verdicts_in_order(spark):
    rows = [("a", "energy", "ASSESSED", 0.5, 50, 50), ("b", "energy", "ASSESSED", 0.001, 50, 50), ("c", "energy", "ASSESSED", 0.001, 50, 5), ("d", "energy", "NOT_ASSESSED", None, 50, 50), ("e", "energy", "ASSESSED", 0.001, 50, 50)]
    metrics = assessment.asymmetric_floor(spark.createDataFrame(rows, "pair string, metric string, status string, p double, n_reference int, n_current int"))
    context = spark.createDataFrame([("e", "SHIFT_PARTIALLY_EXPLAINED")], "pair string, verdict string")
    verdicts = assessment.shift_verdict(metrics, context)
    assert {r.pair: r.verdict for r in verdicts.collect()} == {"a": "NO_SHIFT_DETECTED", "b": "SHIFT_DETECTED_NO_CONTEXT", "c": "INSUFFICIENT_SAMPLE", "d": "NOT_ASSESSED", "e": "SHIFT_PARTIALLY_EXPLAINED"}
    assert {r.pair: (r.severity, round(r.confidence, 3)) for r in assessment.shift_grade(verdicts).collect()} == {"b": ("LOW", 0.99), "e": ("LOW", 0.99)}


def test_psi_permutations_find_the_moved_column(spark):
    rng = np.random.default_rng(2)
    rows = [(c, i, "reference" if i % 2 else "current", float(rng.normal() + (3 if c == "moved" and i % 2 == 0 else 0))) for i in range(120) for c in ("still", "moved")]
    got = {r.column: r for r in shift.psi_permutation_test(spark.createDataFrame(rows, "column string, id long, side string, value double"), count=199).collect()}
    assert got["moved"].p == pytest.approx(1 / 200) and got["moved"].significant and not got["still"].significant


def test_exact_sets_and_exit_codes(spark):
    kind = "position int, code string"
    got = assessment.exact_sets(spark.createDataFrame([(0, "A"), (1, "B")], kind), spark.createDataFrame([(0, "A"), (1, "C"), (2, "D")], kind), ["position"], "code").orderBy("position").collect()
    assert [(r.equal, r.missing, r.unexpected) for r in got] == [(True, [], []), (False, ["B"], ["C"]), (False, [], ["D"])]
    assert [assessment.exit_code(d) for d in ("ACCEPT", "REVIEW", "NOT_ASSESSED", "QUARANTINE")] == [0, 1, 2, 3]


def test_stable_digest_ignores_order_and_volatile_columns(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "a int, b string, at int")
    b = spark.createDataFrame([(2, "y", 9), (1, "x", 8)], "a int, b string, at int").select("b", "at", "a")
    assert assessment.stable_digest(a, ("at",)) == assessment.stable_digest(b, ("at",)) != assessment.stable_digest(a)


def corpus(spark, n=80):
    return spark.createDataFrame([(i, f"sample number {i} of many words and more {i * 7}", "ab"[i % 2], f"c{i % 4}") for i in range(n)], "sample_id long, content string, label string, contributor string")


def test_duplicate_flood_is_found_and_attributed(spark):
    samples, truth = scenarios.duplicate_flood(corpus(spark), "c1", 3, 6)
    groups = duplicates.exact_groups(samples, "sample_id", F.col("content"), "contributor").collect()
    assert [(r.n, r.contributor, r.severity) for r in groups] == [(7, "c1", "MEDIUM")] * 3
    flags = samples.join(truth, "sample_id", "left_semi").select(F.col("sample_id").alias("id"), F.lit("duplicate_flood").alias("attack_class"))
    tests = contributors.over_represented(samples.select(F.col("sample_id").alias("id"), "contributor"), flags, 1.0, "MEDIUM").where("reported").collect()
    assert [r.contributor for r in tests] == ["c1"]
    rows = samples.select("sample_id").join(truth.withColumn("actual", F.lit(True)), "sample_id", "left").withColumn("actual", F.coalesce("actual", F.lit(False)))
    rows = rows.select(F.lit("duplicate_flood").alias("attack_class"), F.col("actual").alias("predicted"), "actual", F.lit(False).alias("tolerated"), (~F.col("actual")).alias("clean"))
    assert (lambda r: (r.precision, r.recall, r.fpr))(contributors.confusion(rows).first()) == (1.0, 1.0, 0.0)


def test_label_scenarios_change_what_they_say(spark):
    base = corpus(spark)
    for changed, truth in (scenarios.label_flip(base, 9, ["a", "b"]), scenarios.systematic_mislabel(base, "c1", "b", "a", 0.5)):
        moved = {r.sample_id for r in base.join(changed.select("sample_id", F.col("label").alias("new")), "sample_id").where("label != new").collect()}
        assert moved == {r.sample_id for r in truth.collect()} and moved


def test_log_scenarios(spark):
    log = spark.createDataFrame([("l", i, i, f"d{i}", f"d{i - 1}" if i else None) for i in range(6)], "log_id string, line long, sequence long, digest string, previous string")
    anchors = provenance.build_anchors(provenance.chain_links(log))
    says = lambda x: (lambda r: (r.status, r.truncation))(provenance.chain_summary(provenance.chain_links(x), anchors).first())
    assert says(log) == ("INTACT", "VERIFIED_COMPLETE")
    assert says(scenarios.truncated(log, 4)) == ("INTACT", "TRUNCATION_DETECTED")
    assert says(scenarios.front_truncated(log, 2)) == ("BROKEN", "FRONT_TRUNCATION_DETECTED")
    for broken in (scenarios.deleted(log, 2), scenarios.reordered(log, 2, 3), scenarios.edited(log, 2), scenarios.repeated(log, 2)):
        assert says(broken)[0] == "BROKEN"


def test_permutation_tests_read_every_row(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") < 25_000, "reference").otherwise("current").alias("side"), F.when(F.col("id") == 49_999, "rare").otherwise((F.col("id") % 3).cast("string")).alias("category"))
    got = shift.categorical_permutation_test(rows, 3).first()
    assert (got.n_reference, got.n_current, got.appeared, got.vanished, got.replicates) == (25_000, 25_000, 1, 0, 3)
    drawn = shift.permuted_sides(spark.range(997), 400, 5, "s").where("side = 'reference'")
    key = lambda b, i: (__import__("hashlib").sha256(f"s|{b}|{i}".encode()).hexdigest(), i)
    assert {(r.replicate, r.id) for r in drawn.collect()} == {(b, i) for b in range(1, 6) for i in sorted(range(997), key=lambda i: key(b, i))[:400]}
    values = spark.range(6_000).select(F.lit("v").alias("column"), "id", F.when(F.col("id") % 2 == 0, "reference").otherwise("current").alias("side"), ((F.col("id") * 7919) % 6_007).cast("double").alias("value"))
    assert shift.psi_permutation_test(values, count=2).first().psi == shift.psi(values).first().psi


def test_activation_queries_score_every_vector(spark, tmp_path):
    from plumbline.plans import forensic_queries

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2600, 6))
    x[2590:, 2] += 12
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = forensic_queries.activation_spectral(spark, str(tmp_path)).orderBy("probe").collect()
    score = ((x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]) ** 2
    assert np.allclose([r.score for r in got], score) and [r.probe for r in got if r.flagged] == sorted(np.argsort(-score, kind="stable")[:390].tolist())
    two = forensic_queries.activation_clusters(spark, str(tmp_path)).first()
    assert two.n == 2600

"""Records, keys, model files, populations and evaluation beyond what the registered queries cover; sinks and commands."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.functions.statistics import binomial_tail
from plumbline.operators import evaluation, model_files, populations, ranks, records, shift
from plumbline.sources import logs
from plumbline.streaming import replay

DECISION = "seq long, operation string, key_id string, fingerprint string, reason string, at string, valid_from string, valid_until string, purpose string"


def test_a_revoked_key_keeps_what_it_was_and_can_be_trusted_again(spark):
    rows = [
        (1, "revoke", "a", None, "early", "t1", None, None, None),
        (2, "trust", "a", "a", None, "t2", "2020", "2030", "inference"),
        (3, "revoke", "a", None, "lost", "t3", None, None, None),
        (4, "trust", None, "b", None, "t4", None, None, "any"),
        (5, "untrust", "b", None, None, "t5", None, None, None),
        (6, "trust", "b", "b", None, "t6", None, None, "report"),
        (7, "burn", "b", None, "x", "t7", None, None, None),
    ]
    store, refused = records.apply_decisions(spark.createDataFrame(rows, DECISION))
    assert {r.key_id: (r.status, r.valid_from, r.valid_until, r.purpose, r.revoked_at, r.reason) for r in store.collect()} == {"a": ("REVOKED", "2020", "2030", "inference", "t3", "lost"), "b": ("TRUSTED", None, None, "report", None, None)}
    assert sorted((r.seq, r.refused) for r in refused.collect()) == [(1, "NOT_IN_STORE"), (7, "UNKNOWN_OPERATION")]


def test_authority_without_a_store_is_not_checked(spark):
    rows = spark.createDataFrame([(1, "k", True, "2024"), (2, None, None, "2024")], "r long, key_id string, key_id_consistent boolean, timestamp string")
    got = {(x.r, x.check): (x.outcome, x.failure) for x in records.authority_checks(rows, None, "r").collect()}
    assert got == {(1, "key_known"): ("NOT_CHECKED", "UNKNOWN_KEY"), (1, "key_trusted"): ("NOT_CHECKED", None), (2, "key_known"): ("NOT_APPLICABLE", None), (2, "key_trusted"): ("NOT_APPLICABLE", None)}


def test_signatures_and_digests(spark):
    rows = spark.createDataFrame([(1, "VALID"), (2, "INVALID"), (3, "MISSING"), (4, "UNSUPPORTED_ALGORITHM"), (5, None)], "r long, signature_outcome string")
    assert [(x.r, x.outcome, x.failure) for x in records.signature_checks(rows, "r").orderBy("r").collect()] == [(1, "PASS", None), (2, "FAIL", "INVALID_SIGNATURE"), (3, "FAIL", "MISSING_SIGNATURE"), (4, "FAIL", "MALFORMED_SIGNATURE"), (5, "FAIL", "MALFORMED_SIGNATURE")]
    got = rows.select(records.entry_digest(F.lit("p"), F.col("signature_outcome")).alias("e"), records.subject_key(*map(F.lit, "abcd")).alias("s")).distinct()
    assert got.select("e").distinct().count() == 5 and got.select("s").distinct().count() == 1


def test_models_that_cannot_be_compared_and_access(spark):
    a = spark.createDataFrame([("m", 3, "x"), ("n", 3, "x"), ("o", 3, "x")], "model string, classes int, battery string")
    b = spark.createDataFrame([("m", 4, "x"), ("n", 3, "y"), ("o", 3, "x")], "model string, classes int, battery string")
    assert {(r.model, r.reason, r.severity, r.disposition) for r in model_files.comparability(a, b).collect()} == {("m", "class_counts_differ", "CRITICAL", "QUARANTINE"), ("n", "batteries_differ", "CRITICAL", "QUARANTINE")}
    offers = spark.createDataFrame([("m", c) for c in model_files.CAPABILITIES], "model string, capability string")
    assert model_files.consequences(a.where("model = 'm'"), model_files.restrict(offers, True)).count() == 0
    assert {r.capability for r in model_files.consequences(a.where("model = 'm'"), model_files.restrict(offers, False)).collect()} == set(model_files.CAPABILITIES) - {"inference"}
    signals = spark.createDataFrame([("m", 0.5, 1), ("n", 0.49, 1)], "model string, success double, target int")
    structure = spark.createDataFrame([("m", 2.0), ("n", 9.0)], "model string, separation double")
    assert [r.model for r in model_files.corroborations(signals, structure).collect()] == ["m"]


def test_reference_modes_and_floor(spark):
    rows = spark.range(40)
    _, own = populations.select_reference(rows, None)
    marked, few = populations.select_reference(rows, spark.range(20, 60))
    assert tuple(own.first()) == ("self", 40, "ASSESSED") and tuple(few.first()) == ("declared", 20, "NOT_ASSESSED")
    assert marked.where("reference").count() == 20
    assert populations.run_id(seed=1, a=None) == populations.run_id(a=None, seed=1) != populations.run_id(seed=2, a=None)
    assert populations.stream_seed(1, "x") != populations.stream_seed(1, "y")


def test_evaluation_by_exact_sets_and_time(spark):
    e = spark.createDataFrame([("s", "R1"), ("s", "R2"), ("t", "R1")], "scenario string, rule string")
    got = {r.scenario: (r.equal, r.missing, r.unexpected) for r in evaluation.exactly_fired(e, e.where("rule = 'R1'")).collect()}
    assert got == {"s": (False, ["R2"], []), "t": (True, [], [])}
    pairs = evaluation.matched(spark.createDataFrame([("p", "A"), ("q", "B")], "pair string, verdict string"), spark.createDataFrame([("p", "A")], "pair string, verdict string"), "pair", "verdict")
    assert {r.pair: r.matched for r in pairs.collect()} == {"p": True, "q": False}
    assert set(evaluation.timed(lambda: spark.range(3), 2)) == {"mean", "p50", "p95"}


def test_quantiles_and_running_totals_over_many_partitions(spark):
    rows = spark.range(1, 1001).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v")).repartition(7)
    got = {r.g: r.q for r in ranks.quantiles(rows, "g", "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, [0.0, 0.1, 0.5, 0.99, 1.0]))).alias("q")).collect()}
    assert {g: [round(x, 9) for x in q] for g, q in got.items()} == {g: [round(x, 9) for x in q] for g, q in want.items()}
    total = ranks.running_total(spark.range(500).repartition(5), "id", "id", descending=True).collect()
    assert all(r.upto == sum(range(r.id, 500)) for r in total)


def test_binomial_tails_of_very_many_trials(spark):
    rows = spark.createDataFrame([(50_000_600, 100_000_000, 0.5), (49_990_000, 100_000_000, 0.5), (3, 100_000_000, 1e-8)], "k long, n long, p double")
    got = [r[0] for r in rows.select(binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0.45221, abs=2e-4) and got[1] == pytest.approx(0.97725, abs=2e-4)
    assert got[2] == pytest.approx(1.0, abs=1e-6)  # the share is kept from 1e-6 on


def test_claims_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(1, "d", None, "n", "l", 0)], "seen long, digest string, key_id string, nonce string, log_id string, sequence long")
    assert {r.kind for r in replay.claims_of(rows).collect()} == {"REPLAY_EXACT", "SEQUENCE_COLLISION"}


def test_reports_and_reference_lists(spark, tmp_path):
    found = spark.createDataFrame([("F-1", "LOW", 0.5, None), ("F-2", "HIGH", 1.0, "x")], "finding_id string, severity string, confidence double, contributor string")
    cover = spark.createDataFrame([("a", "SUPPORTED")], "attack_class string, coverage string")
    logs.write_report(found.coalesce(1), cover, f"{tmp_path}/report")
    lines = [json.loads(x) for x in spark.read.text(f"{tmp_path}/report/findings").toPandas()["value"]]
    assert [x["finding_id"] for x in lines] == ["F-2", "F-1"] and lines[1]["contributor"] is None
    for name, text, want in (("a", '["x", "y", "x"]', {"x", "y"}), ("b", '{"samples": ["z"]}', {"z"})):
        (tmp_path / name).write_text(text)
        assert {r.id for r in logs.read_reference_ids(spark, str(tmp_path / name)).collect()} == want
    (tmp_path / "c").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        logs.read_reference_ids(spark, str(tmp_path / "c"))


def test_commands_for_manifests_keys_and_shift(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "c"), ("2", "b", "c")], "id string, content string, contributor string")
    rows.write.parquet(f"{tmp_path}/t")
    rows.where("id = '1'").write.parquet(f"{tmp_path}/u")
    assert main(["dataset", "manifest", f"{tmp_path}/t", "--out", f"{tmp_path}/m"]) == 0
    assert main(["dataset", "verify", f"{tmp_path}/t", "--manifest", f"{tmp_path}/m"]) == 0
    assert main(["dataset", "verify", f"{tmp_path}/u", "--manifest", f"{tmp_path}/m"]) == 1
    spark.createDataFrame([(1, "trust", "x", "a", None, "t", None, None, "any")], DECISION).write.parquet(f"{tmp_path}/d")
    assert main(["trust", "apply", f"{tmp_path}/d", "--out", f"{tmp_path}/s"]) == 1
    sides = spark.range(100).select(F.lit("c").alias("column"), F.when(F.col("id") < 50, "reference").otherwise("current").alias("side"), F.col("id").cast("double").alias("value"))
    sides.write.parquet(f"{tmp_path}/v")
    assert main(["shift", "psi", f"{tmp_path}/v", "--out", f"{tmp_path}/w"]) == 0
    assert spark.read.parquet(f"{tmp_path}/w").first().psi == shift.psi(sides).first().psi > 1


def test_permutations_drawn_from_counts_are_draws_without_replacement(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(shift, "DRAWN_ROWS", 40)
    rng = np.random.default_rng(3)
    same, moved = rng.integers(0, 60, 700).astype(float), np.concatenate([rng.normal(0, 1, 350), rng.normal(1, 1, 350)])
    rows = [(c, int(i), "reference" if i < 350 else "current", float(v)) for c, x in (("same", same), ("moved", moved)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "column string, id long, side string, value double")
    got = {r.column: r for r in shift.psi_permutation_test(df.repartition(5), count=199).collect()}
    assert got["moved"].p == 1 / 200 and got["same"].p > 0.02 and got["moved"].replicates == 199
    # The null is that of relabelling rows: its middle agrees with relabelling done row by row.
    null = []
    for b in range(199):
        side = rng.permutation(np.repeat(["reference", "current"], 350))
        edges = np.unique(np.quantile(same[side == "reference"], np.arange(11) / 10))
        p, q = (np.maximum(np.bincount(np.searchsorted(edges[1:-1], same[side == s], side="right"), minlength=len(edges) - 1), 0.5) / 350 for s in ("reference", "current"))
        null.append(((q - p) * np.log(q / p)).sum())
    assert abs(np.mean(np.array(null) >= got["same"].psi) - got["same"].p) < 0.12
    again = {r.column: r for r in shift.psi_permutation_test(df.repartition(2), count=199).collect()}
    assert again == got

"""The combined outlier detector against a plain version that fits every fold on its own, and its use in a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import outliers
from plumbline.plans import pipelines

KIND = "id long, vector array<double>, reference boolean"


def fit(x, components):
    mean = x.mean(axis=0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    k = max(1, min(components, int((s**2 > max(1e-24, s[0] ** 2 * x.shape[1] * np.finfo(float).eps)).sum()), len(x) - 1))
    axes = vt[:k]
    z = (x - mean) @ axes.T
    # Ledoit and Wolf's weight, from the rows themselves.
    n, d = z.shape
    cov = z.T @ z / n
    mu = np.trace(cov) / d
    spread = ((cov - mu * np.eye(d)) ** 2).sum() / d
    noise = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / d / n**2
    weight = min(noise, spread) / spread if spread else 1.0
    return mean, axes, z, np.linalg.inv((1 - weight) * cov + weight * mu * np.eye(d))


def score(model, x, k):
    mean, axes, z, precision = model
    a = (x - mean) @ axes.T
    far = np.sort(np.sqrt(((a[:, None] - z[None]) ** 2).sum(axis=2)), axis=1)[:, :k].mean(axis=1)
    return {"mahalanobis": np.einsum("ij,jk,ik->i", a, precision, a), "knn": far, "residual": np.linalg.norm(x - mean - a @ axes, axis=1)}


def plain(ids, x, reference, folds=5, k=5, rate=0.01, components=48):
    rows = np.flatnonzero(reference)
    rows = rows[np.argsort(ids[rows])]
    folds = max(2, min(folds, len(rows) // 2)) if len(rows) >= 4 else 2
    place = np.arange(len(rows)) % folds
    own = {m: np.zeros(len(rows)) for m in outliers.METHODS}
    total = {m: np.zeros(len(x)) for m in outliers.METHODS}
    for f in range(folds):
        model = fit(x[rows[place != f]], components)
        for m, v in score(model, x[rows[place == f]], k).items():
            own[m][place == f] = v
        for m, v in score(model, x, k).items():
            total[m] += v / folds
    out = {}
    for m in outliers.METHODS:
        total[m][rows] = own[m]
        v, held = np.round(total[m], 9), np.round(own[m], 9)
        threshold = np.quantile(held, 1 - rate / 3, method="higher")
        out[m] = v, threshold, np.array([((held >= s).sum() + 1) / (len(held) + 1) for s in v])
    return out


def table(spark, ids, x, reference):
    return spark.createDataFrame([(int(i), v.tolist(), bool(r)) for i, v, r in zip(ids, x, reference)], KIND).repartition(3)


def test_scores_equal_fits_of_every_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 9)) @ rng.normal(size=(9, 9)) + 50
    x[:, 4] = x[:, 3]  # an axis without variance
    x[200:210] += 30
    ids = rng.permutation(1000)[:240]
    reference = np.arange(240) < 180
    want = plain(ids, x, reference, components=4)
    dealt, folds = outliers.assign_folds(table(spark, ids, x, reference))
    models = outliers.fit_folds(dealt, folds, 4)
    assert [m.n for m in models] == [144] * 5
    got = {r.id: r for r in outliers.subspace_scores(dealt, models).join(outliers.neighbour_scores(dealt, models), "id").collect()}
    for m in outliers.METHODS:
        np.testing.assert_allclose([got[int(i)][m] for i in ids], want[m][0], rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("block", [4096, 50])
def test_judgement_equals_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(outliers, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x[190:] += 12
    ids, reference = np.arange(200) * 3, np.arange(200) < 150
    rows = {r.id: r for r in outliers.combined_outliers(table(spark, ids, x, reference), True).collect()}
    want = plain(ids, x, reference)
    assert len(rows) == 200
    for at, i in enumerate(ids.tolist()):
        r = rows[i]
        over = []
        for m in ("mahalanobis", "knn"):
            v, threshold, p = want[m]
            assert r[m] == pytest.approx(v[at], rel=1e-6, abs=1e-7) and r[f"{m}_threshold"] == pytest.approx(threshold, rel=1e-6) and r[f"{m}_p"] == pytest.approx(p[at])
            if v[at] > threshold:
                over.append(m)
        assert [m for m in r.exceeded if m != "residual"] == sorted(over)
        assert r.flagged == bool(r.exceeded) and (r.severity is None) != r.flagged
        assert r.min_p == min(r[f"{m}_p"] for m in outliers.METHODS) and r.score == pytest.approx(1 - r.min_p)
    assert all({"mahalanobis", "knn"} <= set(rows[i].exceeded) for i in ids[190:].tolist())
    assert sum(r.flagged for r in rows.values() if r.reference) <= 5


def test_small_and_empty_references(spark):
    few = table(spark, np.arange(2), np.ones((2, 3)), np.ones(2, bool))
    assert not outliers.combined_outliers(few, True).collect()
    assert not outliers.combined_outliers(few.limit(0), True).collect()
    same = table(spark, np.arange(40), np.ones((40, 3)), np.ones(40, bool))
    assert not any(r.flagged for r in outliers.combined_outliers(same, False).collect())


def test_a_scan_reports_inserted_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6) + (15 if i >= 115 else 0)], "ab"[i % 2]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    samples = spark.createDataFrame([(i, f"text number {i} of its own {i * 7919}", "c") for i in range(120)], "id long, content string, contributor string")
    report = pipelines.scan_dataset(samples, vectors, reference=vectors.where("id < 110").select("id"))
    found = report.findings.where("attack_class = 'ood_insertion'").collect()
    assert {f.asset for f in found} == {str(i) for i in range(115, 120)}
    methods = report.tables["outliers"].where("id >= 115").select(F.size("exceeded").alias("n")).collect()
    assert all(r.n >= 2 for r in methods)

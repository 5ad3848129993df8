"""Distances to neighbours in the outlier detector's cells: exact over tiles, blocks and cells, with few pairs worked out."""

import numpy as np
import pytest

from plumbline.operators import neighbours, outliers


def brute(a, b, k):
    return np.array([np.sort(np.sqrt(((row - b) ** 2).sum(axis=1)))[:k] for row in a])


def kinds():
    rng = np.random.default_rng(5)
    few = np.repeat(rng.normal(size=(6, 7)), 50, axis=0)
    return {
        "spread": rng.normal(size=(300, 48)),
        "copies": few,
        "near copies": few + rng.normal(size=few.shape) * 1e-6,
        "one crowd": rng.normal(size=(1, 48)) + rng.normal(size=(400, 48)) * 1e-6,
        "far rows": rng.normal(size=(300, 9)) * np.where(rng.random((300, 1)) < 0.02, 1e9, 1),
        "small": rng.normal(size=(300, 4)) * 1e-150,
        "all scales": rng.normal(size=(300, 4)) * 10.0 ** rng.integers(-30, 20, (300, 1)),
        "nothing": np.zeros((300, 3)),
        "fewer than k": rng.normal(size=(2, 3)),
    }


@pytest.mark.parametrize("block, tile", [(1024, 1024), (50, 37), (3, 5)])
def test_distances_equal_brute_force(monkeypatch, block, tile):
    monkeypatch.setattr(outliers, "BLOCK_ROWS", block)
    monkeypatch.setattr(outliers, "TILE_ROWS", tile)
    for name, b in kinds().items():
        a = np.concatenate([b[::7], b[::9] + b.std() / 10])
        np.testing.assert_allclose(outliers._nearest_distances(a, b, 5), brute(a, b, 5), rtol=1e-12, atol=0, err_msg=name)


def test_few_pairs_are_worked_out(monkeypatch):
    worked = []
    plain = outliers._squares
    monkeypatch.setattr(outliers, "_squares", lambda a, b, row, at: (worked.append(len(row)), plain(a, b, row, at))[1])
    rng = np.random.default_rng(6)
    b = rng.normal(size=(20_000, 48))
    outliers._nearest_distances(b[:200] + rng.normal(size=(200, 48)), b, 5)
    assert sum(worked) < 60 * 200
    worked.clear()
    crowd = rng.normal(size=(1, 48)) + rng.normal(size=(20_000, 48)) * 1e-4  # single precision does not tell these apart
    outliers._nearest_distances(crowd[:200], crowd, 5)
    assert sum(worked) < 60 * 200
    worked.clear()
    assert not outliers._nearest_distances(np.ones((200, 4)), np.ones((20_000, 4)), 5).any()
    assert sum(worked) == 5 * 200


def test_near_rows_far_from_the_mean_over_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    # Rows a thousandth apart in two places a hundred thousand from their mean: sums of squares would lose their distances.
    x = rng.normal(size=(160, 4)) * 1e-3 + np.where(np.arange(160) % 2, 1e5, -1e5)[:, None]
    rows = spark.createDataFrame([(i, v.tolist(), i < 120) for i, v in enumerate(x)], "id long, vector array<double>, reference boolean")
    dealt, folds = outliers.assign_folds(rows)
    models = outliers.fit_folds(dealt, folds)
    fold = np.where(np.arange(160) < 120, np.arange(160) % folds, -1)
    want = np.zeros(160)
    for i in range(160):
        asked = [m for m in models if fold[i] in (-1, m.fold)]
        for m in asked:
            fitted = x[:120][fold[:120] != m.fold]
            want[i] += np.sort(np.linalg.norm((fitted - x[i]) @ m.axes.T, axis=1))[:5].mean() / len(asked)
    for numbers in (4_000_000, 160):
        monkeypatch.setattr(neighbours, "CELL_NUMBERS", numbers)
        got = {r.id: r.knn for r in outliers.neighbour_scores(dealt, models).collect()}
        np.testing.assert_allclose([got[i] for i in range(160)], want, rtol=1e-5)

"""Nearest rows over several chunks, tiles and blocks, with ties and rows apart, against brute force."""

import numpy as np
import pytest

from plumbline.operators import neighbours


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_over_chunks_and_blocks(spark, monkeypatch, metric):
    for name, value in (("BLOCK_ROWS", 64), ("TILE_ROWS", 50), ("CELL_NUMBERS", 700)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(120, 5)), rng.integers(1, 6, 120), axis=0) + (1e4 if metric == "euclidean" else 0)
    x = x[rng.permutation(len(x))]
    groups = [[int(g)] if g < 40 else None for g in rng.integers(0, 60, len(x))]
    rows = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups, strict=True))], "id long, vector array<double>, apart array<long>")
    got = {}
    for r in neighbours.nearest(rows, rows, 7, metric).collect():
        got.setdefault(r.query, []).append((r.place, r.point, r.value))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        value = -np.einsum("ij,ij->i", unit, np.broadcast_to(unit[i], unit.shape)) if metric == "cosine" else np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        free = [j for j in range(len(x)) if j != i and not (groups[i] and groups[j] and groups[i] == groups[j])]
        want = sorted(free, key=lambda j: (value[j], j))[:7]
        mine = sorted(got[i])
        assert [p for _, p, _ in mine] == want
        assert [abs(v) for _, _, v in mine] == pytest.approx([abs(value[j]) for j in want], abs=1e-12)

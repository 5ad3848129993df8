"""Vector search and vector near-dedup against brute force, with rows that take no part."""

import numpy as np
import pytest

from plumbline.llm import ann
from plumbline.llm.ann import Index, scan_list, search
from plumbline.llm.embedding_dedup import near_components, plan_tables, table_codes
from plumbline.llm.vectors import rotation

KIND = "vec_id long, embedding array<float>, label int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash") for i, v, c in rows], KIND)


def rows_of(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    rows = [(i, x[i].tolist(), i % 3) for i in range(n)]
    rows += [(10_000 + i, x[7].tolist(), 1) for i in range(30)]  # copies of a vector
    bad = [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], []]
    return rows, rows + [(20_000 + i, v, 1) for i, v in enumerate(bad)]


def test_search_recall_ties_and_rows_that_take_no_part(spark):
    good, rows = rows_of(900)
    df = table(spark, rows)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], np.float64)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(score, 12))) if ids[k] != q][:20]
        have = sorted(got[q])
        assert [h[0] for h in have] == list(range(1, 21))
        assert all(abs(s - score[ids == v][0]) < 1e-9 for _, v, s in have)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(have, have[1:]))
        hits += len({h[1] for h in have} & {ids[k] for k in order})
        total += 20
    assert set(got) == {i for i in ids if i % 20 == 0}
    assert hits / total >= 0.9


@pytest.mark.parametrize(("coarse", "held"), [(6, 1 << 22), (1024, 40), (6, 40)])
def test_lists_grow_beyond_the_coarse_centroids(spark, monkeypatch, coarse, held):
    monkeypatch.setattr(ann, "COARSE", coarse)
    monkeypatch.setattr(ann, "HELD", held)
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "LIST_QUERIES", 8)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 12)) + 3 * rng.standard_normal((8, 12))[rng.integers(0, 8, 600)]
    df = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))])
    x = x.astype(np.float32).astype(float)
    index = ann.fit(df, 600)
    assert len(index.centroids) * len(index.inner) >= 20 and (coarse > 6 or len(index.inner) > 1)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert np.mean([len(set(got[q]) & set(np.argsort(-score[q])[:5].tolist())) / 5 for q in range(0, 600, 20)]) > 0.9


def test_search_of_few_rows_returns_all_candidates(spark):
    df = table(spark, [(i, [float(i + 1), 1.0], 0) for i in range(5)])
    got = search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 3, 2, 1]


def test_search_of_nothing(spark):
    df = table(spark, [])
    assert search(df, df).collect() == []


def test_the_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 63))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index(1.0, np.zeros((1, 64)), rotation(64, 3), np.zeros(0), np.zeros((0, 63)), 1)
    true = np.argsort(-(x[:50] @ x.T), axis=1)[:, 1:21]
    bound = 2 - 2 * np.take_along_axis(x[:50] @ x.T, true, axis=1)[:, -1] + 1e-9
    qi, xi, _ = scan_list(x[:50], np.arange(50), bound, x, np.arange(3000), index)
    found = [set(xi[qi == q]) for q in range(50)]
    assert np.mean([len(f & set(t)) / 20 for f, t in zip(found, true)]) > 0.97


def brute(rows, least):
    out = {}
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(good)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                if good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= least:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least_of = {}
    for a, (i, *_) in enumerate(good):
        least_of[find(a)] = min(i, least_of.get(find(a), i))
    for a, (i, *_) in enumerate(good):
        out[i] = (links[a], least_of[find(a)])
    return out


def test_near_vectors_link_within_their_label(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 24))
    rows = []
    for k in range(360):  # groups of near copies, some of them large
        v = base[k % 12 if k % 2 else 0] + 0.12 * rng.standard_normal(24)
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(2000, rows[0][1], 1), (2001, rows[0][1], None), (2002, None, 0), (2003, [0.0] * 24, 0), (2004, [float("nan")] * 24, 0)]
    want = brute(rows, 0.93)
    got = {r.vec_id: r for r in near_components(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    linked = sum(want.get(i, (0, i))[0] for i in got)
    assert all(r.n_links <= want.get(i, (0, i))[0] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * linked
    assert np.mean([r.component_id == want.get(i, (0, i))[1] for i, r in got.items()]) > 0.97
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert got[2001].n_links == got[2002].n_links == got[2003].n_links == got[2004].n_links == 0
    assert got[1000].component_id == 0 and got[1000].n_links >= 5


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 0.0], 0)], [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)]])
def test_near_vectors_of_tiny_tables(spark, rows):
    got = near_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == 1 and r.kept for r in got)
    assert all(r.n_links == len(rows) - 1 for r in got)


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (6, [0.99, 0.05, 0.0], 1), (7, [0.05, 0.99, 0.0], 1), (8, [0.0, 0.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_components(table(spark, rows)).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 0, 8)]


@pytest.mark.parametrize("common", [0.0, 0.7, 0.85])
def test_plans_meet_pairs_at_the_threshold_despite_a_common_direction(common):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.eye(48)[0]
    x = np.sqrt(common) * axis + np.sqrt(1 - common) * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, turn, bits, tables = plan_tables(x[:2000], 100_000, 0.93)
    one = x[2000:]
    w = rng.standard_normal(one.shape)
    w -= (w * one).sum(axis=1, keepdims=True) * one
    other = 0.93 * one + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    met = (table_codes(one - mean, turn, bits) == table_codes(other - mean, turn, bits)).any(axis=1)
    assert met.mean() > 0.94 and turn.shape[1] == bits * tables

import math
import random

import numpy as np
import pytest

from dispatchlens.llm import ann, pivots, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, ids long, score string"


@pytest.fixture
def embeddings(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 0, "v", 1, "s") for i, v in rows], SCHEMA)

    return make


def rows(n=400, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    own = [(i, (centres[i % 6] + 0.7 * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    hot = own[7][1]
    own += [(n + i, hot) for i in range(40)]  # one vector in many rows
    odd = [(None, own[0][1]), (1000, None), (1001, [1.0, None] + [0.0] * (dims - 2)), (1002, [math.nan] * dims), (1003, [math.inf] * dims), (1004, []), own[20], (1020, [0.0] * dims)]
    return own + odd, own


def true(own, every, k, score):
    own = dict(own)
    out = {}
    for q in own:
        if q % every == 0:
            best = sorted(((-score(own[q], own[i]), i) for i in own if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def scaled(v):
    return [math.floor(256 * float(x)) for x in v]


def test_pivot_search_is_exact(embeddings, monkeypatch):
    given, own = rows()
    own += [(1020, given[-1][1])]
    want = true(own, 50, 5, lambda a, b: sum(x * y for x, y in zip(scaled(a), scaled(b))))
    for blocks, step in ((4096, 256), (64, 16)):
        monkeypatch.setattr(vectors, "CANDIDATES", blocks)
        monkeypatch.setattr(vectors, "QUERIES", max(2, blocks // 32))
        monkeypatch.setattr(pivots, "STEP", step)
        monkeypatch.setattr(pivots, "ASKED", max(5, blocks // 8))
        monkeypatch.setattr(pivots, "INTERVALS", max(7, blocks // 64))
        assert by_query(pivots.pivot_search(embeddings(given)).collect()) == want


def test_pivot_search_in_clusters_and_ties(embeddings, monkeypatch):
    rng = np.random.default_rng(8)
    centres = 4 * rng.standard_normal((8, 6))
    own = [(i, (centres[i % 8] + 0.05 * rng.standard_normal(6)).tolist()) for i in range(600)]
    own += [(1000 + i, [0.0] * 5 + [float(i)]) for i in range(40)] + [(1050, [0.0] * 6)]  # queries with equal scores everywhere
    want = true(own, 50, 5, lambda a, b: sum(x * y for x, y in zip(scaled(a), scaled(b))))
    monkeypatch.setattr(vectors, "CANDIDATES", 40)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    assert by_query(pivots.pivot_search(embeddings(own)).collect()) == want


def test_intervals_bound_their_blocks_and_leave_far_ones_out():
    rng = np.random.default_rng(4)
    centres = 100 * rng.standard_normal((10, 5))
    x = np.repeat(centres, 30, axis=0) + rng.standard_normal((300, 5))
    longest2 = float((x**2).sum(1).max())
    points = pivots.choose_pivots(pivots.lifted(x, longest2), 12)
    table = pivots.distances(pivots.lifted(x, longest2), points).reshape(10, 30, -1)
    q = x[::30]
    own = pivots.distances(np.column_stack([q, np.zeros(10)]), points)
    reach = pivots.reachable((q**2).sum(1), longest2, pivots.outside(own, table.min(1), table.max(1)))
    scores = (q @ x.T).reshape(10, 10, 30)
    assert (reach[:, :, None] >= scores).all()
    home = reach.argmax(1)
    floor = np.sort(scores[np.arange(10), home], axis=1)[:, -6]
    assert (reach >= floor[:, None]).mean() < 0.6


def test_pivot_bound_holds_and_ends_early():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (500, 4))
    longest2 = float((x**2).sum(1).max())
    q = np.array([40, 40, 0, 0])
    points = pivots.choose_pivots(pivots.lifted(x.astype(float), longest2), 8)
    table = pivots.distances(pivots.lifted(x.astype(float), longest2), points)
    own = pivots.distances(np.append(q, 0.0)[None, :], points)
    bound = np.abs(own - table).max(1)
    reach = ((q**2).sum() + longest2 - bound**2) / 2 + 1e-6
    assert (reach >= x @ q).all()
    places, scores = pivots.best(q, reach, x, 3)
    assert sorted(scores)[-3:] == sorted(x @ q)[-3:]


def test_nearest_neighbours_recall_and_scores(embeddings, monkeypatch):
    given, own = rows(900, 24)
    dot = lambda a, b: float(np.cumsum(np.array(a, float) * np.array(b, float))[-1])
    want = true(own, 20, 20, dot)
    for size in (4096, 32):  # small lists and chunks are split and give the same
        monkeypatch.setattr(vectors, "CANDIDATES", size)
        monkeypatch.setattr(ann, "LIST_ROWS", 100)
        found = by_query(ann.nearest_neighbours(embeddings(given)).collect())
        assert set(found) == set(want)
        hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        exact = dict(own)
        assert all(abs(s - dot(exact[q], exact[i])) < 1e-12 for q in found for i, s in found[q])


@pytest.mark.parametrize("sparse", [0.0, 0.2, 1.1])
def test_scan_keeps_the_nearest(monkeypatch, sparse):
    monkeypatch.setattr(ann, "SPARSE", sparse)
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((300, 64)), rng.standard_normal((20, 64))
    far = ((x[None] - q[:, None]) ** 2).sum(2)
    blocks = [np.ascontiguousarray(x.T[i : i + 16]) for i in range(0, 64, 16)]
    own, places = ann.scan(q, blocks, 10, np.full(20, np.inf))
    true = {(i, j) for i in range(20) for j in np.argsort(far[i])[:10].tolist()}
    assert len(true - set(zip(own.tolist(), places.tolist()))) <= 10 and len(own) <= 200
    limits = np.sort(far, axis=1)[:, 4]
    own, places = ann.scan(q, blocks, 10, limits)
    assert all(far[i, j] <= limits[i] * (1 + 1e-6) for i, j in zip(own, places)) and len(own) >= 95


def test_few_and_no_rows(embeddings):
    few = [(0, [1.0, 2.0]), (1, [3.0, 4.0, 5.0])]  # vectors of different lengths
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in pivots.pivot_search(embeddings(few)).collect()] == [(0, 1, 1, 65536 * 11)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(embeddings(few)).collect()] == [(0, 1, 1, 11.0)]
    for search in (pivots.pivot_search, ann.nearest_neighbours):
        assert search(embeddings([])).collect() == []
        assert search(embeddings([(0, None), (20, [])])).collect() == []


@pytest.mark.parametrize("n", [300, 15])
def test_every_query_gets_k_rows_where_there_are_as_many(embeddings, monkeypatch, n):
    monkeypatch.setattr(ann, "LIST_ROWS", 8)  # the one probed list holds fewer than k
    monkeypatch.setattr(ann, "fit_probes", lambda *_: 1)
    rng = np.random.default_rng(7)
    given = [(i, rng.standard_normal(40).tolist()) for i in range(n)]
    found = by_query(ann.nearest_neighbours(embeddings(given), 20, 5).collect())
    assert set(found) == set(range(0, n, 5))
    assert all(len({i for i, _ in own} - {q}) == len(own) == min(20, n - 1) for q, own in found.items())


def test_short_queries_are_searched_as_well_as_long_ones(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.2 * rng.standard_normal((3000, 24))
    x *= (np.exp(rng.normal(0, 1, 3000)) / np.linalg.norm(x, axis=1))[:, None]
    x[::60] *= 1e-6  # queries
    got = ann.nearest_neighbours(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), 20, 60).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 3000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9 and np.quantile(recall, 0.05) >= 0.5


def test_probes_serve_the_worst_queries_too():
    rng = np.random.default_rng(12)
    points = rng.standard_normal((2000, 8))
    centres = ann.fit_centroids(points, 20)
    probes = ann.fit_probes(points, points[:300], centres, 20)
    own, order = ann.nearest(points, centres, 1)[:, 0], ann.nearest(points[:300], centres, probes)
    true = np.argsort(((points[:300, None] - points[None]) ** 2).sum(2), axis=1, kind="stable")[:, 1:21]
    recall = [np.isin(own[t], o).mean() for t, o in zip(true, order)]
    assert np.mean(recall) >= ann.TARGET_RECALL and np.quantile(recall, 0.05) >= ann.TARGET_TAIL


def test_nearest_in_steps_equals_a_whole_scan(monkeypatch):
    rng = np.random.default_rng(13)
    points, centres = rng.standard_normal((500, 6)), rng.standard_normal((30, 6))
    whole = ann.nearest(points, centres, 5)
    monkeypatch.setattr(ann, "PAIRS", 100)
    assert (ann.nearest(points, centres, 5) == whole).all() and (ann.nearest(points, centres, 1)[:, 0] == whole[:, 0]).all()

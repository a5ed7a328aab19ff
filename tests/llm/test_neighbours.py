"""Neighbours against brute force, with copies, scaled, zero and odd vectors."""

import numpy as np

from intentlake.llm import neighbours, queries
from intentlake.llm.neighbours import Pivots, best_in_block, footrule, most_similar

SCHEMA = "k bigint, e array<float>, id string, v string, class int, place int"


def brute(ids, x, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out[a] = {ids[j]: s[i, j] for j in order}
    return out


def clusters(seed=0, n=60, size=8, d=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, d))
    return np.concatenate([c + 0.3 * rng.normal(size=(size, d)) for c in centres])


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "a", "b", 1, 2) for k, v in rows], SCHEMA)


def test_recall_and_places(spark):
    x = clusters()
    ids = list(range(1, len(x) + 1))
    rows = list(zip(ids, x))
    rows += [(900, np.zeros(64)), (901, None), (902, np.ones(32)), (903, [None] * 64), (904, [float("nan")] * 64), (None, x[0]), (1, x[0])]
    got = most_similar(frame(spark, rows), "k", "e").collect()
    truth = brute(ids, x)
    found = {}
    for r in got:
        found.setdefault(r.id, {})[r.neighbour] = (r.place, r.cosine)
    assert set(found) == set(ids) and all(len(v) == 5 and i not in v for i, v in found.items())
    near = [(i, j) for i, v in truth.items() for j, c in v.items() if c >= 0.85]
    assert near and sum(j in found[i] for i, j in near) >= 0.95 * len(near)
    for v in found.values():
        by_place = sorted(v.values())
        assert [p for p, _ in by_place] == [1, 2, 3, 4, 5] and all(a[1] >= b[1] for a, b in zip(by_place, by_place[1:]))


def test_copies_go_by_the_smaller_id(spark):
    x = clusters(1, 10, 4)
    rows = [(i + 100, v) for i, v in enumerate(x)] + [(i, x[0]) for i in range(1, 31)]
    got = most_similar(frame(spark, rows), "k", "e").collect()
    lists = {}
    for r in got:
        lists.setdefault(r.id, []).append((r.place, r.neighbour))
    assert [n for _, n in sorted(lists[20])] == [1, 2, 3, 4, 5]
    assert [n for _, n in sorted(lists[3])] == [1, 2, 4, 5, 6]
    assert [n for _, n in sorted(lists[100])] == [1, 2, 3, 4, 5]


def test_long_posting_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    x = clusters(2)
    ids = list(range(len(x)))
    truth = brute(ids, x)
    found = {}
    for r in most_similar(frame(spark, list(zip(ids, x))), "k", "e", floor=0.85).collect():
        found.setdefault(r.id, set()).add(r.neighbour)
    near = [(i, j) for i, v in truth.items() for j, c in v.items() if c >= 0.86]
    assert sum(j in found.get(i, ()) for i, j in near) >= 0.95 * len(near)


def test_few_and_no_vectors(spark):
    assert most_similar(frame(spark, []), "k", "e").count() == 0
    assert most_similar(frame(spark, [(1, np.ones(64))]), "k", "e").count() == 0
    two = most_similar(frame(spark, [(1, np.ones(64)), (2, 5 * np.ones(64))]), "k", "e").collect()
    assert {(r.id, r.neighbour, round(r.cosine, 6)) for r in two} == {(1, 2, 1.0), (2, 1, 1.0)}


def test_footrule_is_the_sum_of_differences_of_places():
    rng = np.random.default_rng(5)
    x = np.array([rng.permutation(9)[:4] for _ in range(12)], np.uint16)
    plain = [[sum(abs((list(a).index(p) if p in a else 4) - (list(b).index(p) if p in b else 4)) for p in set(a) | set(b)) for b in x] for a in x]
    assert footrule(x, x).tolist() == plain


def test_pivots_come_nearest_first():
    rng = np.random.default_rng(6)
    x, p = rng.normal(size=(20, 8)).astype(np.float32), rng.normal(size=(15, 8)).astype(np.float32)
    s = x @ p.T
    assert (Pivots(p).nearest(x, 4) == np.argsort(-s, axis=1)[:, :4]).all()
    side = {"id": np.arange(20), "v": x, "perm": Pivots(p).nearest(x, 4)}
    assert best_in_block({**side, "id": side["id"][:0]}, side, False, 3, -1) == []


def test_far_neighbours_are_found_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "FAR_BLOCK", 150)
    x = np.random.default_rng(8).normal(size=(500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    found = {}
    for r in queries.p4_neighbours(spark, str(tmp_path)).collect():
        found.setdefault(r.vec_id, set()).add(r.neighbour)
    truth = brute(list(range(len(x))), x)
    assert all(found[i] == set(v) for i, v in truth.items())


def test_search_among_many_cells(monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    p = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3).astype(np.float32)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    x = p[:300] + rng.normal(size=(300, 16)).astype(np.float32) * 0.05
    exact = Pivots(p).nearest(x, 6)
    monkeypatch.setattr(neighbours, "PER_CELL", 20)
    monkeypatch.setattr(neighbours, "PROBES", 24)
    few = Pivots(p)
    assert len(few.centres) == 200
    assert (few.nearest(x, 6) == exact).mean() > 0.95
    assert few.nearest(x[:0], 6).shape == (0, 6)

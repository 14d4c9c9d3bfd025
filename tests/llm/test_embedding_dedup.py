import random

import numpy as np
import pytest

from sylva.llm import vectors


def brute(rows):
    n = len(rows)
    x = np.array([r[1] if r[1] and None not in r[1] and len(r[1]) == 8 else [0] * 8 for r in rows], float)
    ok = np.isfinite(x).all(1) & (x != 0).any(1) & np.array([r[2] is not None and r[0] is not None for r in rows])
    x = np.where(ok[:, None], x, 0)
    x = x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (x @ x.T >= 0.98) & ok[:, None] & ok & (label[:, None] == label) & ~np.eye(n, dtype=bool)
    group = [r[0] for r in rows]
    for _ in range(n):
        new = [min([group[i], *[group[j] for j in np.flatnonzero(link[i])]]) if ok[i] else group[i] for i in range(n)]
        if new == group:
            break
        group = new
    return sorted(((r[0], int(link[i].sum()), group[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("span", "run"), [(4, 4096), (1, 20), (3, 7)])
def test_matches_brute_force(spark, monkeypatch, span, run):
    monkeypatch.setattr(vectors, "SPAN", span)
    monkeypatch.setattr(vectors, "RUN", run)
    monkeypatch.setattr(vectors, "SLICE", 11)
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=8)
            for _ in range(int(rng.choice([1, 3, 40]))):
                rows.append((i, (centre + rng.normal(size=8) * rng.choice([0.02, 0.12])).tolist(), label))
                i += 1
    rows += [(i + k, rows[5][1], rows[5][2]) for k in range(150)]
    i += 150
    centre = rng.normal(size=8)
    rows += [(i + k, (centre + rng.normal(size=8) * 0.002).tolist(), 1) for k in range(120)]  # a dense run of many parts
    i += 120
    rows += [(i, None, 0), (i + 1, [0.0] * 8, 0), (i + 2, [float("nan")] + [1.0] * 7, 0), (i + 3, rows[5][1], None), (i + 4, [None] + [1.0] * 7, 1), (i + 5, [float("inf")] * 8, 1), (i + 6, [1e300] * 8, 1), (i + 7, [2e300] * 8, 1)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, component_id int")
    got = vectors.near_vectors(df, block=16).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute([(a, b if b is None or b[0] is None or abs(b[0]) < 1e200 else ([1.0] * 8 if abs(b[0]) < 1e301 else b), c) for a, b, c in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (4, [1.0], 3), (5, [], 3)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_plan_keeps_recall():
    for n in (10, 5_000, 10**7, 10**10):
        bits, passes = vectors.plan(n)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** passes <= 1e-4

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions import distances
from sylva.operators import density, knn, pca


def rows(spark, x, kind="double"):
    return spark.createDataFrame([(i, [float(v) for v in r] if kind == "double" else list(r)) for i, r in enumerate(x)], f"row_id long, vector array<{kind}>")


def yule(spark, a, b, n, compat=False):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    return df.select(distances.yule(F.col("a"), F.col("b"), n, compat).alias("d")).first().d


def test_yule(spark):
    assert yule(spark, [1, 6, 9, 10, 14, 15], [1, 5, 6, 10, 11, 13], 16) == pytest.approx(0.6)
    assert yule(spark, [0, 1, 2], [1, 2, 3], 8) == pytest.approx(2 / 9)
    assert math.isnan(yule(spark, [0], [0], 1)) and math.isnan(yule(spark, [], [1], 4))
    assert {n: distances.simd_bits(n) for n in (16, 100, 128, 300, 1000, 30000)} == {16: 0, 100: 0, 128: 256, 300: 256, 1000: 1024, 30000: 29952}
    assert math.isnan(yule(spark, [1], [2], 64, True)) and yule(spark, [1, 299], [2, 299], 300, True) == pytest.approx(2.0)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(distances.cosine(F.col("a"), F.col("b")).alias("c"), distances.l2(F.col("a"), F.col("b")).alias("l")).collect()
    assert got[0].c == pytest.approx(1 - 1 / math.sqrt(2)) and got[0].l == 1 and math.isnan(got[1].c)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 12))
    assert distances.block("cosine", x, 3 * x) == pytest.approx(distances.block("cosine", x, x).T)
    b = spark.createDataFrame([([1, 4], [2, 4])], "a array<int>, b array<int>")
    r = b.select(distances.bit_or(F.col("a"), F.col("b")).alias("o"), distances.bit_and(F.col("a"), F.col("b")).alias("n"), distances.bit_string(F.col("a"), 6).alias("s"), distances.bit_set(F.col("a"), 2).alias("t"), distances.bit_get(F.col("a"), 4).alias("g")).first()
    assert (r.o, r.n, r.s, r.t, r.g) == ([1, 2, 4], [4], "010010", [1, 2, 4], True)


@pytest.mark.parametrize("metric", ["cosine", "l2", "yule"])
def test_knn_and_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 200)
    monkeypatch.setattr(knn, "ROWS", 7)
    monkeypatch.setattr(knn, "CELLS", 20)
    monkeypatch.setattr("sylva.operators.blocks.ROWS", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 10)) if metric != "yule" else (rng.random((30, 10)) < 0.5).astype(float)
    x[4] = 0
    x[9] = x[3]
    df = rows(spark, x) if metric != "yule" else rows(spark, [np.flatnonzero(r).tolist() for r in x], "int")
    bits = 10 if metric == "yule" else None
    d = distances.block(metric, x, x)
    got = knn.knn(df.where("row_id % 5 = 0"), df, 4, metric, bits).orderBy("query_id", "rank").collect()
    for q in range(0, 30, 5):
        want = sorted(range(30), key=lambda j: (math.isnan(d[q, j]), round(d[q, j], 12) if not math.isnan(d[q, j]) else 0, j))[:4]
        assert [r.row_id for r in got if r.query_id == q] == want
    pairs = {(r.i, r.j): r.distance for r in knn.pairwise(df, metric, bits).collect()}
    assert len(pairs) == 30 * 31 // 2 and all(v == pytest.approx(d[i, j], abs=1e-7, nan_ok=True) for (i, j), v in pairs.items())


def sequential(dist, eps, minpts):
    """Seeds in order of id; a point is expanded once, border points stay with the first cluster."""
    n = len(dist)
    near = [np.flatnonzero(dist[i] <= eps).tolist() for i in range(n)]
    seen, label = [False] * n, [None] * n
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        if len(near[i]) <= minpts:
            continue
        queue = list(near[i])
        if label[i] is None:
            label[i] = i
        while queue:
            j = queue.pop(0)
            if not seen[j]:
                seen[j] = True
                if len(near[j]) >= minpts:
                    queue += near[j]
            if label[j] is None:
                label[j] = i
    return label


def test_density_matches_a_sequential_scan(spark):
    rng = random.Random(5)
    for trial in range(6):
        x = np.array([[rng.randrange(12), rng.randrange(12)] for _ in range(70)], float)
        minpts = rng.choice([2, 3, 4])
        eps = [1.0, 1.5, 2.0]
        df = rows(spark, x)
        nb = density.neighbours_on_grid(df, 2.0) if trial % 2 else density.neighbours(df, 2.0, "l2")
        got = density.dbscan_many(nb.cache(), eps, minpts, task_pairs=0 if trial == 1 else 10**6).collect()
        for k, e in enumerate(eps):
            want = sequential(distances.block("l2", x, x), e, minpts)
            assert {r.row_id: r.label for r in got if r.step == k} == {i: v for i, v in enumerate(want) if v is not None}
            names = sorted({v for v in want if v is not None})
            assert all(names[r.cluster] == r.label for r in got if r.step == k)


def test_density_of_any_row_ids(spark):
    rng = random.Random(7)
    x = np.array([[rng.randrange(10), rng.randrange(10)] for _ in range(80)], float)
    ids = sorted(rng.sample([*range(-(1 << 63), 1 << 63, 1 << 56)], 76) + [-1, 0, (1 << 63) - 1, 1 << 44])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, vector array<double>")
    nb = density.neighbours_on_grid(df, 2.0).cache()
    eps = [1.0, 1.5, 2.0]
    one, many = (sorted(map(tuple, density.dbscan_many(nb, eps, 3, task_pairs=n).collect())) for n in (10**6, 0))
    want = [(k, ids[i], ids[v]) for k, e in enumerate(eps) for i, v in enumerate(sequential(distances.block("l2", x, x), e, 3)) if v is not None]
    assert [r[:3] for r in one] == sorted(want) and one == many


def test_density_on_a_grid_matches_a_sequential_scan(spark):
    rng = random.Random(12)
    for dims in (1, 2, 3):
        x = np.array([[rng.randrange(9) + 0.3 * rng.randrange(2) for _ in range(dims)] for _ in range(90)] + [[40.0] * dims] * 30)
        ids = sorted(rng.sample([*range(-(1 << 63), 1 << 63, 1 << 56)], len(x)))
        odd = [(1, None), (2, [float("nan")] * dims), (3, [float("inf")] * dims)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + odd, "row_id long, vector array<double>")
        eps = [0.5, 1.0, 1.5, 20.0]
        one, many = (sorted(map(tuple, density.dbscan_on_grid(df, eps, 4, task_pairs=n).collect())) for n in (10**6, 0))
        want = [(k, ids[i], ids[v]) for k, e in enumerate(eps) for i, v in enumerate(sequential(distances.block("l2", x, x), e, 4)) if v is not None]
        assert [r[:3] for r in one] == sorted(want) and one == many
    assert density.dbscan_on_grid(df.limit(0), eps, 4).count() == 0


def test_clusters_are_counted_without_their_points(spark):
    rng = random.Random(17)
    for dims, minpts in ((1, 2), (2, 3), (2, 5), (3, 4)):
        x = np.array([[rng.randrange(9) + 0.3 * rng.randrange(2) for _ in range(dims)] for _ in range(90)] + [[40.0] * dims] * 30)
        df = rows(spark, x[rng.sample(range(len(x)), len(x))])
        x = np.array([r.vector for r in df.orderBy("row_id").collect()])
        eps = [0.1, 0.35, 0.5, 1.0, 1.5, 20.0]
        want = [len({v for v in sequential(distances.block("l2", x, x), e, minpts) if v is not None}) for e in eps]
        for n in (10**6, 0):
            got = density.clusters_on_grid(df, eps, minpts, n)
            assert [got.get(k, 0) for k in range(len(eps))] == want
        assert density.tiles(df, [20.0], minpts, True).count() < 20 < len(x) <= density.tiles(df, [20.0], minpts).count()


def test_points_are_found_for_layers_alone(spark, monkeypatch):
    from sylva.plans import registry

    line = [0.001 * i for i in range(8)]
    df = rows(spark, np.array([[a, 0.0] for a in line] + [[0.15 + a, 0.0] for a in line] + [[9.0, 9.0]]))
    found, plain = [], density.dbscan_on_grid
    monkeypatch.setattr(registry, "plane", lambda *_: df)
    monkeypatch.setattr(density, "dbscan_on_grid", lambda rows, radii, *more: found.extend(radii) or plain(rows, radii, *more))
    assert [tuple(r) for r in registry.layer_stats(spark, "").orderBy("layer").collect()] == [(0, 0, 2), (1, 25, 1)] and not found
    assert [tuple(r) for r in registry.cluster_counts(spark, "").orderBy("layer").collect()] == [(0, 2), (1, 1)] and found == pytest.approx([0.02, 0.145])


def test_layers_from_rows_that_tell_clusters_apart(spark, monkeypatch):
    monkeypatch.setattr(density, "THIN_FROM", 0, raising=False)
    rng, dealt, said, tiles, counts = random.Random(23), [], [], density.tiles, density._counts
    monkeypatch.setattr(density, "tiles", lambda rows, radii, *more: dealt.append((rows.count(), radii)) or tiles(rows, radii, *more))
    monkeypatch.setattr(density, "_counts", lambda found: said.append(counts(found)) or said[-1])
    for dims, minpts, start, step, ways in ((1, 2, 0.02, 0.03, (10**6,)), (2, 3, 0.12, 0.06, (10**6, 0)), (2, 5, 0.2, 0.05, (10**6,)), (3, 2, 0.25, 0.06, (10**6,))):
        blob = lambda n, at, wide: [[at + rng.uniform(0, wide)] + [rng.uniform(0, wide) for _ in range(dims - 1)] for _ in range(n)]
        x = np.array(blob(50, 0, 1) + blob(30, 1.9, 0.7) + blob(25, 4.5, 0.6) + blob(12, 0, 6) + [[2.75] + [0.3] * (dims - 1)] * minpts)
        ids = sorted(rng.sample([*range(-(1 << 63), 1 << 63, 1 << 56)], len(x)))
        x = x[rng.sample(range(len(x)), len(x))]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1, None), (2, [float("inf")] * dims)], "row_id long, vector array<double>")
        d = distances.block("l2", x, x)
        for n in ways:
            dealt.clear(), said.clear()
            found = density.adaptive_on_grid(df.coalesce(1), start, step, minpts, task_pairs=n)
            want = [[len({v for v in sequential(d, e, minpts) if v is not None}) for e in radii] for _, radii in dealt]
            assert [[g.get(k, 0) for k in range(len(radii))] for g, (_, radii) in zip(said, dealt, strict=True)] == want
            assert found.stats[0][3] > found.stats[-1][3] == 1 and min(kept for kept, _ in dealt) < len(x)


def test_rows_amid_their_cluster_are_looked_at_once(spark, monkeypatch):
    monkeypatch.setattr(density, "THIN_FROM", 0, raising=False)
    rng, dealt, plain = np.random.default_rng(3), [], density.tiles
    x = np.concatenate([rng.uniform(0, 0.3, (3000, 2)), rng.uniform(0, 0.3, (3000, 2)) + (0.6, 0), [[0.1, 0.6]]])
    monkeypatch.setattr(density, "tiles", lambda rows, *more: dealt.append(rows.count()) or plain(rows, *more))
    found = density.adaptive_on_grid(rows(spark, x).cache(), 0.02, 0.005, 5)
    assert [s[3] for s in found.stats] == [2, 1] and dealt[0] == len(x) and max(dealt[1:3]) < 100


def test_members_from_rows_that_tell_clusters_apart(spark, monkeypatch):
    monkeypatch.setattr(density, "THIN_FROM", 0, raising=False)
    rng, dealt, plain = np.random.default_rng(29), [], density.tiles
    x = np.concatenate([rng.uniform(0, 0.3, (900, 2)), rng.uniform(0, 0.3, (900, 2)) + (0.6, 0), rng.uniform(0, 1, (60, 2)), rng.uniform(0, 0.1, (200, 2)) + (0, 0.6)])
    df = rows(spark, x[rng.permutation(len(x))]).cache()
    monkeypatch.setattr(density, "tiles", lambda rows, *more, **named: dealt.append(rows.count()) or plain(rows, *more, **named))
    found = density.adaptive_on_grid(df, 0.02, 0.01, 5)
    dealt.clear()
    got = sorted(tuple(r) for r in found.members.collect())
    assert len(found.stats) > 2 and dealt and max(dealt) < len(x)
    want = density.dbscan_on_grid(df, [radius for _, _, radius, _ in found.stats], 5)
    assert got == sorted(tuple(r) for r in want.collect())


def test_layers_of_rows_with_many_neighbours(spark, monkeypatch):
    from sylva.plans import registry

    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 0.004, (6000, 2)), rng.normal(0, 0.004, (6000, 2)) + (0.6, 0), np.zeros((2000, 2))])  # some 100 million pairs
    df = rows(spark, x).repartition(4).cache()
    assert density.tiles(df, [0.02, 0.3], 5).count() < 2 * 2 * len(x)
    monkeypatch.setattr(registry, "plane", lambda *_: df)
    found = registry.layers(spark, "")
    assert [s[3] for s in found.stats][-2:] == [2, 1] and found.members.where("layer = %d" % found.stats[-1][0]).count() == len(x)


def test_layers_by_joins(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.1, (15, 2)) for c in ((0, 0), (1, 0), (0, 1.3))])
    grid = lambda r: density.neighbours_on_grid(rows(spark, x), r)
    got = [density.adaptive(grid, 0.15, 0.1, 4, 40, task_pairs=n) for n in (10**6, 0)]
    assert got[0].stats == got[1].stats and sorted(got[0].members.collect()) == sorted(got[1].members.collect())


def test_layers_shrink_and_children_have_one_parent(spark):
    from sylva.operators import tree

    rng = np.random.default_rng(3)
    centres = [(0, 0), (1, 0), (0, 9), (1.2, 9), (9, 4)]
    x = np.concatenate([rng.normal(c, 0.12, (25, 2)) for c in centres])
    df = rows(spark, x)
    found = density.adaptive(lambda r: density.neighbours_on_grid(df, r), 0.3, 0.3, 4, 40)
    counts = [s[3] for s in found.stats]
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == len(counts) and counts[-1] == 1 and len(counts) >= 3
    edges = tree.edges(found.members)
    assert edges.groupBy("child_layer", "child").count().where("count > 1").isEmpty()
    nodes = tree.nodes(found.members)
    assert tree.tree_stats(nodes).first().nodes == sum(counts)
    text = tree.newick(tree.nested(nodes))
    assert text.endswith(";") and text.count("C") == sum(counts)

    def names(n):
        return [n["name"]] + [x for c in n["children"] or [] for x in names(c)]

    assert sorted(names(tree.parse_newick(text))) == sorted(x for r in tree.nested(nodes) for x in names(r)) or len(tree.nested(nodes)) > 1


def test_halving_and_no_clusters(spark):
    x = np.array([[0.0, 0.0]] * 8 + [[50.0 * i, 9.0] for i in range(4)])
    df = rows(spark, x)
    with pytest.raises(ValueError):
        density.adaptive(lambda r: density.neighbours_on_grid(df, r), 1.0, 1.0, 3, 8)
    found = density.adaptive(lambda r: density.neighbours_on_grid(df.where("row_id >= 8"), r), 1.0, 1.0, 3, 8)
    assert [s[3] for s in found.stats] == [0] and found.members.count() == 0


def test_layers_go_on_until_one_cluster_is_left(spark, monkeypatch):
    from sylva.plans import registry

    line = [0.001 * i for i in range(8)]
    df = rows(spark, np.array([[a, 0.0] for a in line] + [[0.15 + a, 0.0] for a in line]))  # joined at 0.143, after 25 radii
    monkeypatch.setattr(registry, "plane", lambda *_: df)
    found = registry.layers(spark, "")
    assert [s[3] for s in found.stats] == [2, 1] and found.stats[1][2] == pytest.approx(0.145)
    grid = lambda r: density.neighbours_on_grid(df, r)
    with pytest.raises(ValueError, match="2 clusters are left"):
        density.adaptive(grid, 0.02, 0.005, 5, 3)
    assert [s[3] for s in density.adaptive(grid, 0.02, 0.005, 5, largest=0.05).stats] == [2]


def test_yule_of_whole_blocks(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((12, 300)) < 0.4).astype(float)
    sets = [np.flatnonzero(r).tolist() for r in x]
    d = distances.block("yule_simd", x, x, 300)
    assert all(d[0, k] == pytest.approx(yule(spark, sets[0], sets[k], 300, True), nan_ok=True) for k in range(12))
    assert not np.allclose(d[0, 1:], distances.block("yule", x, x, 300)[0, 1:])
    assert np.isnan(distances.block("yule_simd", x[:, :64], x[:, :64], 64)).all()
    got = knn.knn(rows(spark, sets[:2], "int"), rows(spark, sets, "int"), 3, "yule_simd", 300).orderBy("query_id", "rank").collect()
    for q in range(2):
        assert [r.row_id for r in got if r.query_id == q] == sorted(range(12), key=lambda j: (d[q, j], j))[:3]


def test_ties_and_nan_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 9)
    x = np.array([[1.0, 0.0]] * 40 + [[0.0, 0.0]] * 10 + [[0.0, 1.0]] * 3)
    got = knn.knn(rows(spark, x).where("row_id in (5, 45)"), rows(spark, x), 44).collect()
    by = {q: [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (5, 45)}
    assert by == {5: [*range(40), 50, 51, 52, 40], 45: list(range(44))}


def test_numbers_follow_the_order(spark):
    from sylva.session import numbered

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(50), i, "x") for i in range(500)], "a int, row int, part string").repartition(7)
    got = numbered(df, ["a", "row"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(500)) and [(r.a, r.row) for r in got] == sorted((r.a, r.row) for r in got) and got[0].part == "x"
    assert numbered(df.limit(0), ["a"], "n").count() == 0


def test_pca_far_from_zero(spark):
    x = np.random.default_rng(5).normal(size=(200, 70))
    model = pca.fit(rows(spark, x + 1e7).repartition(9))
    assert model.covariance == pytest.approx(np.cov((x + 1e7 - 1e7).T, bias=True), abs=1e-8)
    assert pca.fit(rows(spark, x).limit(0)).values.size == 0


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(51, 5)) @ rng.normal(size=(5, 5)) + 3
    model = pca.fit(rows(spark, x))
    cov = np.cov(x.T, bias=True)
    assert model.covariance == pytest.approx(cov) and model.values == pytest.approx(np.linalg.eigvalsh(cov))
    got = np.array([r.pc for r in pca.project(rows(spark, x), model, 2).orderBy("row_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(x @ np.linalg.eigh(cov)[1][:, ::-1][:, :2]))
    compat = pca.fit(rows(spark, x), tail_compat=True).covariance
    centred = (x - x.mean(0))[:48]
    assert compat == pytest.approx(centred.T @ centred / 51)


def test_rule_in_one_task_matches_a_sequential_scan():
    import pyarrow as pa

    rng = random.Random(11)
    for _ in range(400):
        x = np.array([[rng.randrange(9), rng.randrange(9)] for _ in range(rng.randint(1, 45))], float)
        d, minpts = distances.block("l2", x, x), rng.randint(1, 6)
        i, j = np.nonzero(d <= 1.5)
        got = density._label(minpts)(pa.table({"step": np.zeros(len(i), np.int64), "i": i, "j": j})).to_pylist()
        assert {r["row_id"]: r["label"] for r in got} == {k: v for k, v in enumerate(sequential(d, 1.5, minpts)) if v is not None}


#: What queries of layers give for two lines of eight points and one apart.
LAYER_ROWS = {
    "cluster_counts": [(0, 2), (1, 1)],
    "cluster_intersections": [(0, 0, 0, 8), (0, 1, 0, 8)],
    "cluster_members": [(0, k // 8, k % 8, k) for k in range(16)] + [(1, 0, k, k) for k in range(16)],
    "cluster_sub_vdb": [(0, 0, 8, 0.028, 0.0), (0, 1, 8, 1.228, 0.0), (1, 0, 16, 1.256, 0.0)],
    "contingency": [(0, 0, 0, 4), (0, 0, 1, 4), (0, 1, 0, 4), (0, 1, 1, 4), (1, 0, 0, 8), (1, 0, 1, 8)],
    "every_nth_leaf": [(0,)],
    "layer_coverage": [(0, 16, 1, 0.941176), (1, 16, 1, 0.941176)],
    "mapping_rows": [("L0C0N8", 8, "0,1,2,3,4,5,6,7", None), ("L0C1N8", 8, "8,9,10,11,12,13,14,15", None), ("L1C0N16", 16, ",".join(map(str, range(16))), None)],
    "layer_edges": [(1, 0, 0, 0, 8), (1, 0, 0, 1, 8)],
    "nmi_score": [(0, 16, 0.0), (1, 16, None)],
    "node_label_mix": [(0, 0, 0, 4, 1.0), (0, 0, 1, 4, 1.0), (0, 1, 0, 4, 1.0), (0, 1, 1, 4, 1.0), (1, 0, 0, 8, 1.0), (1, 0, 1, 8, 1.0)],
    "mapping_with_labels": [("L0C0N8", 8, "0,1,2,3,4,5,6,7", "field 0_"), ("L0C1N8", 8, "8,9,10,11,12,13,14,15", None), ("L1C0N16", 16, ",".join(map(str, range(16))), "field 0_")],
    "newick": [("(L0C0N8,L0C1N8)L1C0N16;",)],
    "newick_edges": [("L0C0N8", "L1C0N16"), ("L0C1N8", "L1C0N16"), ("L1C0N16", None)],
}


@pytest.mark.parametrize("name", LAYER_ROWS)
def test_layer_queries_list_no_pairs(spark, monkeypatch, name):
    from sylva.plans import registry

    line = [0.001 * i for i in range(8)]
    df = rows(spark, np.array([[a, 0.0] for a in line] + [[0.15 + a, 0.0] for a in line] + [[9.0, 9.0]]))
    monkeypatch.setattr(density, "neighbours_on_grid", None)
    monkeypatch.setattr(registry, "vectors", lambda *_: df)
    monkeypatch.setattr(registry, "plane", lambda *_: df)
    monkeypatch.setattr(registry, "labels", lambda *_: df.selectExpr("row_id", "row_id % 2 as label"))
    got = [tuple(r) for r in getattr(registry, name)(spark, "").collect()]
    assert sorted(got, key=str) == sorted(LAYER_ROWS[name], key=str)


def test_coverage_projects_vectors_once(spark, monkeypatch):
    from sylva.plans import registry

    df = rows(spark, np.array([[0.001 * i, 0.0] for i in range(16)] + [[0.2, 0.0]] * 8))
    made = []
    monkeypatch.setattr(registry, "vectors", lambda *_: df)
    monkeypatch.setattr(registry, "plane", lambda *_: made.append(1) or df)
    assert {r.covered + r.noise for r in registry.layer_coverage(spark, "").collect()} == {24} and len(made) == 1


@pytest.mark.parametrize("name", ["cluster_members", "cluster_sub_vdb"])
def test_rows_of_clusters_are_projected_once(spark, monkeypatch, name):
    from sylva.plans import registry

    df = rows(spark, np.array([[0.001 * i, 0.0] for i in range(8)] + [[0.15 + 0.001 * i, 0.0] for i in range(8)]))
    made = []
    monkeypatch.setattr(registry, "plane", lambda *_: made.append(1) or df)
    got = [tuple(r) for r in getattr(registry, name)(spark, "").collect()]
    assert sorted(got) == sorted(LAYER_ROWS[name]) and len(made) == 1
